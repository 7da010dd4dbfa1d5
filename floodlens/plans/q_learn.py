"""Registered queries: labeled flow-feature dataset, split, threshold rule,
metrics, kernel classifier (M1-M10, F6-F8, A11-A13, U1, S3 path, S10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floodlens.functions.numeric import q, q_sql
from floodlens.operators import learn as L
from floodlens.operators.clean import edge_cleanup
from floodlens.operators.report import five_numbers, scenario_split
from floodlens.plans.fixture import FIXTURE_TH, WATCHED
from floodlens.plans.q_timeline import W9_SQL, _w9
from floodlens.plans.registry import register
from floodlens.schemas import FEATURE_COLUMNS
from floodlens.session import checkpoint_dir, materialize

DIMS = WATCHED
WL = ", ".join(f"'{ip}'" for ip in DIMS.watch_ips)
# Fixed query parameters, scaled to the packet view's rates (EWMA 0.3-4.8)
EDGE_RATE = 1.0            # reference: 5.0 pps
ZONE = (1.0, 3.0)          # reference: 10-200 pps
RULE_THRESHOLD = 2.0       # threshold rule evaluated on the test split
SWEEP = [0.5 * i for i in range(1, 11)]
ID_COLS = ["src_ip", "dst_ip", "window_end_us"]
# The classifier of every model-based query: train_classifier's default features and passes
CLASSIFIER = {"c_param": 10.0, "balanced": True}

DS_SQL = W9_SQL + f""",
mid AS (SELECT (min(window_end_us) + max(window_end_us)) // 2 AS m FROM w9),
ds0 AS (SELECT w9.*, CASE WHEN window_end_us < m THEN 0 ELSE CAST(src_ip IN ({WL}) AS INTEGER) END AS label
        FROM w9, mid),
ds AS (SELECT * FROM ds0 WHERE NOT (label = 1 AND coalesce(packet_rate_ewma < {EDGE_RATE!r}, false))),
sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', src_ip, dst_ip,
          CAST(window_end_us AS VARCHAR), '42'))) AS _r, count(*) OVER (PARTITION BY label) AS _n FROM ds),
spl AS (SELECT *, _r <= round(_n * 0.2) AS is_test FROM sp)
"""


def dataset(spark, sf):
    """W9 features of both sessions, labeled (M1), edge-cleaned (F6), unioned."""
    return edge_cleanup(_labeled(spark, sf), EDGE_RATE)


def _labeled(spark, sf):
    """The feature table is written once: the scenario's midpoint and the two sessions read it."""
    f = scenario_split(materialize(_w9(spark, sf), "features"), ts="window_end_us", names=("normal", "attack"))
    return L.label_sessions(f.filter(F.col("scenario") == "normal"), f.filter(F.col("scenario") == "attack"), DIMS.watch_ips)


def split(spark, sf):
    return L.stratified_split(materialize(dataset(spark, sf), "dataset"), ID_COLS, 0.2, 42)


@register("m01_labels", DS_SQL + "SELECT label, count(*) AS n FROM ds0 GROUP BY label")
def m01(spark, sf):
    return _labeled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("f06_edge_cleanup", DS_SQL + "SELECT src_ip, label, count(*) AS n FROM ds GROUP BY ALL")
def f06(spark, sf):
    return dataset(spark, sf).groupBy("src_ip", "label").agg(F.count(F.lit(1)).alias("n"))


@register("u01_union_sessions", DS_SQL + """
SELECT CASE WHEN window_end_us < (SELECT m FROM mid) THEN 'normal' ELSE 'attack' END AS session, count(*) AS n
FROM ds GROUP BY 1""")
def u01(spark, sf):
    return (dataset(spark, sf).groupBy(F.col("scenario").alias("session"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("a12_label_distribution", DS_SQL + f"""
SELECT label, count(*) AS count, {q_sql('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct,
       {q_sql('min(count(*)) OVER () / max(count(*)) OVER ()')} AS balance_ratio
FROM ds GROUP BY label""")
def a12(spark, sf):
    return L.label_distribution(dataset(spark, sf))


@register("a11_rate_five_numbers", DS_SQL + f"""
SELECT label, {q_sql('qq[1]')} AS min, {q_sql('qq[2]')} AS p25, {q_sql('qq[3]')} AS p50, {q_sql('qq[4]')} AS p75,
       {q_sql('qq[5]')} AS max
FROM (SELECT label, quantile_cont(packet_rate_ewma, [0.0, 0.25, 0.5, 0.75, 1.0]) AS qq FROM ds GROUP BY label) t""")
def a11(spark, sf):
    return five_numbers(dataset(spark, sf), "packet_rate_ewma", "label")


@register("a13_overlap_report", DS_SQL + f"""
SELECT {q_sql('max(CASE WHEN label = 0 THEN packet_rate_ewma END)')} AS normal_max,
       {q_sql('min(CASE WHEN label = 1 THEN packet_rate_ewma END)')} AS attack_min,
       count_if(packet_rate_ewma BETWEEN {ZONE[0]!r} AND {ZONE[1]!r} AND label = 0) AS normal_in_zone,
       count_if(packet_rate_ewma BETWEEN {ZONE[0]!r} AND {ZONE[1]!r} AND label = 1) AS attack_in_zone
FROM ds WHERE is_to_victim = 1""")
def a13(spark, sf):
    return L.overlap_report(dataset(spark, sf), *ZONE)


@register("f07_victim_scope", DS_SQL + "SELECT label, count(*) AS n FROM ds WHERE is_to_victim = 1 GROUP BY label")
def f07(spark, sf):
    return dataset(spark, sf).filter(F.col("is_to_victim") == 1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("f08_rate_range", DS_SQL + f"""
SELECT label, count(*) AS n FROM ds WHERE packet_rate_ewma BETWEEN {ZONE[0]!r} AND {ZONE[1]!r} GROUP BY label""")
def f08(spark, sf):
    from floodlens.operators.clean import rate_range
    return rate_range(dataset(spark, sf), *ZONE).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("m02_stratified_split", DS_SQL + "SELECT label, is_test, count(*) AS n FROM spl GROUP BY ALL")
def m02(spark, sf):
    return split(spark, sf).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("m02_split_members", DS_SQL + "SELECT src_ip, dst_ip, window_end_us, label FROM spl WHERE is_test")
def m02m(spark, sf):
    return split(spark, sf).filter("is_test").select("src_ip", "dst_ip", "window_end_us", "label")


_RULE = f"CAST(packet_rate_ewma >= {RULE_THRESHOLD!r} AS INTEGER)"


@register("m05_confusion_rule", DS_SQL + f"""
SELECT s.label, s.prediction, coalesce(c.n, 0) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(label, prediction)
LEFT JOIN (SELECT label, {_RULE} AS prediction, count(*) AS n FROM spl WHERE is_test GROUP BY ALL) c
  ON s.label = c.label AND s.prediction = c.prediction""")
def m05(spark, sf):
    t = split(spark, sf).filter("is_test")
    return L.confusion(t.withColumn("prediction", (F.col("packet_rate_ewma") >= RULE_THRESHOLD).cast("int")))


_REPORT = """,
cm AS (SELECT s.label, s.prediction, coalesce(c.n, 0) AS count
       FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(label, prediction)
       LEFT JOIN (SELECT label, {rule} AS prediction, count(*) AS n FROM spl WHERE is_test GROUP BY ALL) c
       ON s.label = c.label AND s.prediction = c.prediction),
g AS (SELECT sum(CASE WHEN label = 0 AND prediction = 0 THEN count END) AS c00,
             sum(CASE WHEN label = 0 AND prediction = 1 THEN count END) AS c01,
             sum(CASE WHEN label = 1 AND prediction = 0 THEN count END) AS c10,
             sum(CASE WHEN label = 1 AND prediction = 1 THEN count END) AS c11 FROM cm),
pc AS (SELECT '0' AS cls, c00 AS tp, c10 AS fp, c01 AS fn, c00 + c01 + c10 + c11 AS n, c00 + c11 AS ok FROM g
       UNION ALL SELECT '1', c11, c01, c10, c00 + c01 + c10 + c11, c00 + c11 FROM g),
pr AS (SELECT cls, coalesce(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 0.0) AS precision,
              coalesce(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 0.0) AS recall,
              tp + fn AS support, n, ok FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
       FROM pr),
allr AS (SELECT cls, precision, recall, f1, support FROM pf
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT max(n) AS n, CASE WHEN max(n) = 0 THEN 0.0
                                                  ELSE max(ok) / max(n) END AS a FROM pf) x
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM pf
  UNION ALL SELECT 'weighted avg',
    coalesce(CASE WHEN sum(support) = 0 THEN NULL ELSE sum(precision * support) / sum(support) END, 0.0),
    coalesce(CASE WHEN sum(support) = 0 THEN NULL ELSE sum(recall * support) / sum(support) END, 0.0),
    coalesce(CASE WHEN sum(support) = 0 THEN NULL ELSE sum(f1 * support) / sum(support) END, 0.0), max(n) FROM pf)
SELECT cls, {p} AS precision, {r} AS recall, {f} AS f1, CAST(support AS BIGINT) AS support FROM allr"""


@register("m06_classification_report", DS_SQL + _REPORT.format(
    rule=_RULE, p=q_sql("precision", 4), r=q_sql("recall", 4), f=q_sql("f1", 4)))
def m06(spark, sf):
    t = split(spark, sf).filter("is_test")
    cm = L.confusion(t.withColumn("prediction", (F.col("packet_rate_ewma") >= RULE_THRESHOLD).cast("int")))
    return L.classification_report(cm)


@register("m08_threshold_sweep", DS_SQL + f""",
th AS (SELECT unnest(CAST([{', '.join(repr(t) for t in SWEEP)}] AS DOUBLE[])) AS threshold),
c AS (SELECT threshold, count_if(label = 1 AND packet_rate_ewma >= threshold) AS tp,
             count_if(label = 0 AND packet_rate_ewma >= threshold) AS fp,
             count_if(label = 1 AND NOT (packet_rate_ewma >= threshold)) AS fn FROM th, ds GROUP BY threshold)
SELECT threshold, tp, fp, fn,
  {q_sql('coalesce(CASE WHEN tp = 0 THEN NULL ELSE 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 0.0)', 4)}
  AS f1 FROM c""")
def m08(spark, sf):
    return L.threshold_sweep(dataset(spark, sf), SWEEP)


@register("m08_best_threshold", DS_SQL + f""",
th AS (SELECT unnest(CAST([{', '.join(repr(t) for t in SWEEP)}] AS DOUBLE[])) AS threshold),
c AS (SELECT threshold, count_if(label = 1 AND packet_rate_ewma >= threshold) AS tp,
             count_if(label = 0 AND packet_rate_ewma >= threshold) AS fp,
             count_if(label = 1 AND NOT (packet_rate_ewma >= threshold)) AS fn FROM th, ds GROUP BY threshold),
f AS (SELECT threshold, {q_sql('coalesce(CASE WHEN tp = 0 THEN NULL ELSE 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 0.0)', 4)} AS f1 FROM c)
SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def m08_best(spark, sf):
    return L.best_threshold(L.threshold_sweep(dataset(spark, sf), SWEEP))


# ------------------------------------------------- model-based (rows-only checks)
@register("m10_cross_validated_f1")
def m10_cv(spark, sf):
    """F1 of the kernel classifier of m04 on each of five folds."""
    ds = materialize(dataset(spark, sf), "dataset")
    return L.cross_validated_f1(ds, ID_COLS, **CLASSIFIER)


@register("m04_kernel_classifier")
def m04(spark, sf):
    """M3 + M4 + M9 + M10 + M7 + S10: fit on the train split, save, reload,
    score the test split, confusion matrix."""
    sp = materialize(split(spark, sf), "split")
    train = sp.filter(~F.col("is_test"))
    model = L.train_classifier(train, **CLASSIFIER)
    path = f"{checkpoint_dir(spark).rstrip('/')}/floodlens-models/kernel-svm-{uuid.uuid4().hex[:12]}"
    L.save_model(model, path)
    loaded = L.load_model([f"{path}-missing", path])
    scored = L.score(loaded, sp.filter("is_test"))
    return L.confusion(scored)


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, min({c}) < max({c}) AS kept "
    "FROM spl WHERE NOT is_test" for c in FEATURE_COLUMNS)


@register("m03_scaler_stats", DS_SQL + f""",
st AS ({_STATS})
SELECT feature, {q_sql('mean')} AS mean, {q_sql('std')} AS std FROM st WHERE kept""")
def m03(spark, sf):
    """M3 + M9: constant features removed, then mean and sample std per kept
    feature as fitted on the train split (one row per feature of the model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector, VectorAssembler
    train = materialize(split(spark, sf), "split").filter(~F.col("is_test"))
    prep = Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="_raw"),
        VarianceThresholdSelector(featuresCol="_raw", outputCol="_sel", varianceThreshold=0.0),
        StandardScaler(inputCol="_sel", outputCol="_scaled", withMean=True, withStd=True)]).fit(train)
    kept = [FEATURE_COLUMNS[i] for i in prep.stages[1].selectedFeatures]
    sc = prep.stages[2]
    rows = [(f, float(m), float(sd)) for f, m, sd in zip(kept, sc.mean.toArray(), sc.std.toArray())]
    return spark.createDataFrame(rows, "feature string, mean double, std double") \
        .select("feature", q("mean").alias("mean"), q("std").alias("std"))


@register("m10_class_weights", DS_SQL + f"""
SELECT label, count(*) AS n,
       {q_sql('(SELECT count(*) FROM spl WHERE NOT is_test) / (2.0 * count(*))')} AS weight
FROM spl WHERE NOT is_test GROUP BY label""")
def m10(spark, sf):
    """Balanced class weights of the train split, n / (classes * n_class)."""
    return L.class_weights(split(spark, sf).filter(~F.col("is_test")))


@register("m09_constant_features", DS_SQL + f""",
st AS ({_STATS})
SELECT feature, kept FROM st""")
def m09(spark, sf):
    """M9: features with zero variance on the train split are dropped before
    scaling (one row per feature: kept or not)."""
    from pyspark.ml.feature import VarianceThresholdSelector, VectorAssembler
    train = split(spark, sf).filter(~F.col("is_test"))
    vec = VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="_raw").transform(train)
    sel = VarianceThresholdSelector(featuresCol="_raw", outputCol="_sel", varianceThreshold=0.0).fit(vec)
    kept = set(sel.selectedFeatures)  # indices into the 7 feature columns (model metadata)
    rows = [(f, i in kept) for i, f in enumerate(FEATURE_COLUMNS)]
    return spark.createDataFrame(rows, "feature string, kept boolean")


@register("m07_row_scoring")
def m07(spark, sf):
    """M7: every feature row scored by the kernel classifier of m04, fitted on
    the train split; a row the model cannot score gets 0.
    Result: rows per (label, prediction)."""
    sp = materialize(split(spark, sf), "split")
    model = L.train_classifier(sp.filter(~F.col("is_test")), **CLASSIFIER)
    return L.score(model, sp).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
