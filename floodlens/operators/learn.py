"""Learning: labeling, cleanup, split, scaling, kernel classifier, metrics
(M1-M10, F6-F8, A11-A13, U1, S10).

There is no RBF-kernel SVM in MLlib, so M4 is a random-Fourier-feature map
(Rahimi & Recht, 2007), a matrix product over Arrow batches, followed by a
linear machine with squared hinge loss: an approximation of the kernel machine
whose Newton steps are sums over all rows, for all folds in the same pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.numeric import q
from floodlens.schemas import FEATURE_COLUMNS


# ------------------------------------------------------------- M1 / F6-F8 / U1
def label_sessions(normal: DataFrame, attack: DataFrame, watch_ips: list[str]) -> DataFrame:
    """M1 + U1: normal session -> 0; attack session -> 1 iff the source is watchlisted."""
    n = normal.withColumn("label", F.lit(0))
    a = attack.withColumn("label", F.col("src_ip").isin(watch_ips).cast("int"))
    return n.unionByName(a)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percent per label, and the balance ratio min/max."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over the per-label counts (two rows)
    return (c.withColumn("pct", q(F.col("count") * 100.0 / F.sum("count").over(w)))
            .withColumn("balance_ratio", q(F.min("count").over(w) / F.max("count").over(w))))


def overlap_report(df: DataFrame, lo: float, hi: float, rate: str = "packet_rate_ewma") -> DataFrame:
    """A13 on the victim-bound scope (F7): normal max, attack min, per-label rows in [lo, hi] (F8)."""
    s = df.filter(F.col("is_to_victim") == 1)
    zone = F.col(rate).between(lo, hi)
    return s.agg(q(F.max(F.when(F.col("label") == 0, F.col(rate)))).alias("normal_max"),
                 q(F.min(F.when(F.col("label") == 1, F.col(rate)))).alias("attack_min"),
                 F.count_if(zone & (F.col("label") == 0)).alias("normal_in_zone"),
                 F.count_if(zone & (F.col("label") == 1)).alias("attack_in_zone"))


# ------------------------------------------------------------------------ M2
def stratified_split(df: DataFrame, id_cols: list[str], test_fraction: float = 0.2, seed: int = 42,
                     label: str = "label", buckets_hex: int = 4) -> DataFrame:
    """M2: exact stratified split.  Rows of each label are ordered by
    ``md5(id, seed)``; the first ``round(fraction * n)`` are the test set.

    The k-th smallest hash per label is found without ranking a whole label in
    one task: a histogram over the first ``buckets_hex`` hex digits (65,536
    buckets) locates the bucket holding the cut, and only that bucket's rows
    are ranked.  Adds ``_h`` and ``is_test``."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))
    x = df.withColumn("_h", h).withColumn("_bk", F.substring("_h", 1, buckets_hex))
    n = x.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    k = n.select(label, F.round(F.col("_n") * F.lit(test_fraction)).cast("long").alias("_k"))
    hist = x.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(label).orderBy("_bk")  # one row per (label, bucket): <= 65,536 rows per label
    hist = hist.withColumn("_cum", F.sum("_c").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    cut = (hist.join(k, label).filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
           .select(label, F.col("_bk").alias("_cut_bk"), (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_need")))
    inb = (x.join(F.broadcast(cut), label).filter(F.col("_bk") == F.col("_cut_bk"))
           .withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h")))
           .filter(F.col("_r") == F.col("_need")).select(label, F.col("_h").alias("_cut_h")))
    return (x.join(F.broadcast(inb), label, "left")
            .withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_cut_h"), F.lit(False)))
            .drop("_bk", "_cut_h"))


# ----------------------------------------------------------------------- M10
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class) per label."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the per-label counts (one row per class)
    return c.withColumn("weight", q(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))))


# ------------------------------------------------------------------ M5 / M6
def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M5: 2x2 matrix over a fixed spine (empty cells are 0)."""
    spark = pred.sparkSession
    spine = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "label int, prediction int")
    c = (pred.select(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
         .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")))
    return F.broadcast(spine).join(c, ["label", "prediction"], "left").fillna(0, ["count"])


def classification_report(cm: DataFrame) -> DataFrame:
    """M6: per class precision / recall / F1 / support, accuracy, macro and
    weighted averages (4 dp, 0 where undefined)."""
    g = cm.agg(*[F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("count"))).alias(f"c{a}{b}")
                 for a in (0, 1) for b in (0, 1)])
    rows = []
    for cls, tp, fp, fn in ((0, "c00", "c10", "c01"), (1, "c11", "c01", "c10")):
        p = F.try_divide(F.col(tp), F.col(tp) + F.col(fp))
        r = F.try_divide(F.col(tp), F.col(tp) + F.col(fn))
        f1 = F.try_divide(2 * p * r, p + r)
        rows.append(F.struct(F.lit(str(cls)).alias("cls"), F.coalesce(p, F.lit(0.0)).alias("precision"),
                             F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(f1, F.lit(0.0)).alias("f1"),
                             (F.col(tp) + F.col(fn)).alias("support")))
    per = g.select(F.explode(F.array(*rows)).alias("r"), "c00", "c01", "c10", "c11")
    per = per.select("r.*", (F.col("c00") + F.col("c11")).alias("_ok"),
                     (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")).alias("_n"))
    tot = per.agg(F.first("_ok").alias("_ok"), F.first("_n").alias("_n"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    acc = F.coalesce(F.try_divide(F.col("_ok"), F.col("_n")), F.lit(0.0))
    extra = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("cls"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("_n").alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("_n").alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), F.coalesce("wp", F.lit(0.0)).alias("precision"),
                 F.coalesce("wr", F.lit(0.0)).alias("recall"), F.coalesce("wf", F.lit(0.0)).alias("f1"),
                 F.col("_n").alias("support")))).alias("r")).select("r.*")
    out = per.select("cls", "precision", "recall", "f1", "support").unionByName(extra)
    return out.select("cls", *[q(c, 4).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


# ------------------------------------------------------------------------ M8
def threshold_sweep(df: DataFrame, thresholds: list[float], rate: str = "packet_rate_ewma",
                    label: str = "label") -> DataFrame:
    """M8: F1 of the rule ``rate >= t`` for every t, without pairing rows with
    thresholds: rows are counted per (grid cell, label) and TP/FP per
    threshold are suffix sums over the (small) grid."""
    ts = sorted(thresholds)
    arr = F.array(*[F.lit(float(t)) for t in ts])
    cell = F.size(F.filter(arr, lambda t: t <= F.col(rate)))  # number of thresholds <= rate
    c = (df.select(cell.alias("cell"), F.col(label).alias("label"))
         .groupBy("cell").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "idx int, threshold double")
    # rows predicted positive at threshold idx: cell >= idx; the grid is a fixed small table
    cells = F.broadcast(c)
    j = grid.join(cells, cells["cell"] >= grid["idx"], "left")
    tp = j.groupBy("idx", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"),
                                           F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    allpos = c.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("_p"))
    r = tp.crossJoin(F.broadcast(allpos)).withColumn("fn", F.col("_p") - F.col("tp")).drop("_p")
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return r.select("threshold", "tp", "fp", "fn", q(f1, 4).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """M8: best F1 (lowest threshold among ties)."""
    return sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"),
                     F.max("f1").alias("f1"))


# ------------------------------------------------------------- M3 / M4 / M7
def rff_columns(n_in: int, n_components: int, gamma: float, seed: int = 42):
    """Random Fourier features for exp(-gamma |x-y|^2): z = sqrt(2/D) cos(W x + b)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, n_in))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    return w, b


def require_features(df: DataFrame, features=FEATURE_COLUMNS) -> None:
    """One error that names every missing feature, before any plan is built."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")


class KernelClassifier:
    """Fitted M3/M4 model as small matrices: mean and standard deviation of the
    kept features, random Fourier map (W, b), weights and intercept.

    A batch of rows is scored by two matrix products, in an Arrow batch of Spark's
    or in the state of a stream alike (``margins``)."""

    FIELDS = "features array<string>, kept array<int>, mean array<double>, std array<double>, w array<array<double>>, b array<double>, coef array<double>, intercept double"

    def __init__(self, features, kept, mean, std, w, b, coef, intercept):
        self.features, self.kept = list(features), np.asarray(kept, np.int64)
        self.mean, self.std, self.b, self.coef = (np.asarray(v, float) for v in (mean, std, b, coef))
        self.w, self.intercept = np.asarray(w, float).reshape(len(self.b), len(self.kept)), float(intercept)

    def features_of(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier features of rows of ``features`` (in that order)."""
        return np.sqrt(2.0 / len(self.b)) * np.cos((x[:, self.kept] - self.mean) / self.std @ self.w.T + self.b)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances from the border; NaN where a feature is missing."""
        known = np.isfinite(x).all(axis=1)
        out = np.full(len(x), np.nan)
        out[known] = self.features_of(x[known]) @ self.coef + self.intercept
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """1 beyond the border; 0 also where a row can't be scored."""
        return (self.margins(x) > 0).astype(np.int64)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin`` (null where a feature is missing) and ``prediction``."""
        def margin(x: pd.DataFrame) -> pd.Series:
            return pd.Series(self.margins(x.to_numpy(float)))
        row = F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])
        m = F.pandas_udf(margin, "double")(row)
        return df.withColumn("margin", m).withColumn("prediction", F.coalesce((F.col("margin") > 0) & ~F.isnan("margin"), F.lit(False)).cast("double"))

    def save(self, path: str) -> str:
        from pyspark.sql import SparkSession
        row = (self.features, self.kept.tolist(), self.mean.tolist(), self.std.tolist(), self.w.tolist(), self.b.tolist(), self.coef.tolist(), self.intercept)
        SparkSession.getActiveSession().createDataFrame([row], self.FIELDS).write.mode("overwrite").parquet(f"{path}/rff")
        return path

    @classmethod
    def load(cls, path: str) -> "KernelClassifier":
        from pyspark.sql import SparkSession
        names = [f.split(" ")[0] for f in cls.FIELDS.split(", ")]
        return cls(*SparkSession.getActiveSession().read.parquet(f"{path}/rff").select(*names).first())  # one row


def _added(parts: DataFrame, schema: str) -> dict[int, np.ndarray]:
    """Sums of the ``values`` arrays of each model, in two levels, so that no task
    and no driver gets an array of every task."""
    def add(table: pa.Table) -> pa.Table:
        values = table.column("values").combine_chunks()
        total = values.flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.table({"model": table.column("model")[:1], "slot": table.column("slot")[:1], "values": pa.array([total], pa.list_(pa.float64()))})
    first = parts.groupBy("model", "slot").applyInArrow(add, schema)
    return {r["model"]: np.array(r["values"]) for r in first.withColumn("slot", F.lit(0)).groupBy("model", "slot").applyInArrow(add, schema).collect()}


def fit_classifiers(rows: DataFrame, folds: int, features=FEATURE_COLUMNS, label: str = "label", c_param: float = 10.0, n_components: int = 64,
                    seed: int = 42, balanced: bool = False, drop_constant: bool = True, max_iter: int = 50) -> list[KernelClassifier]:
    """M3 + M4 (+ M9 constant-feature removal, M10 balanced weights) for each fold
    of the column ``fold`` at once: model k learns from the rows of all folds but k,
    and model ``folds`` from all rows.

    Scaling uses the sample standard deviation; gamma is 'scale' (1 / features on
    standardised data).  The machine minimises ``|w|^2 / 2 + C sum(a max(0, 1 - y f)^2)``
    (``a`` = class weight) by Newton steps: one pass over the rows adds up
    gradient, Hessian and loss of every model, a task its rows, Spark the tasks,
    and only these sums (``n_components`` squared numbers a model) reach the driver.
    A step that does not lower the loss is halved.  Rows with a missing feature
    or label teach nothing; models without rows predict 0."""
    from floodlens.session import materialize

    feats = list(features)
    require_features(rows, feats)
    known = F.lit(True)
    for c in feats:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    x = materialize(rows.where(known & F.col(label).isNotNull()).select(
        F.col("fold").cast("int").alias("fold"), (F.col(label) == 1).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in feats]), "classifier-rows")
    stats = x.groupBy("fold", "y").agg(F.count(F.lit(1)), *[f(c) for c in feats for f in (F.avg, F.var_pop)]).collect()  # two rows a fold
    d = n_components

    models, weights = [], []
    for k in range(folds + 1):
        part = [r for r in stats if r[0] != k]
        n = sum(r[2] for r in part)
        mean = np.array([sum(r[2] * r[3 + 2 * j] for r in part) / max(n, 1) for j in range(len(feats))])
        spread = np.array([sum(r[2] * (r[4 + 2 * j] + (r[3 + 2 * j] - mean[j]) ** 2) for r in part) for j in range(len(feats))])
        std = np.sqrt(spread / max(n - 1, 1))
        flat = std <= 1e-12 * np.maximum(1.0, np.abs(mean))  # constant but for rounding
        kept = np.flatnonzero(~flat) if drop_constant else np.arange(len(feats))
        w, b = rff_columns(max(len(kept), 1), d, 1.0 / max(len(kept), 1), seed)
        models.append(KernelClassifier(feats, kept, mean[kept], np.where(flat, 1.0, std)[kept], w[:, :len(kept)], b, np.zeros(d), 0.0))
        of = {y: sum(r[2] for r in part if r[1] == y) for y in (0, 1)}
        present = sum(c > 0 for c in of.values())
        weights.append([n / (present * of[y]) if balanced and of[y] else 1.0 for y in (0, 1)])

    schema, size = "model int, slot int, values array<double>", (d + 1) * (d + 1) + d + 3

    def sums(thetas: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def run(batches):
            from pyspark import TaskContext
            totals = {k: np.zeros(size) for k in thetas}
            for batch in batches:
                fold, y = batch.column("fold").to_numpy(), 2.0 * batch.column("y").to_numpy() - 1.0
                rows = np.column_stack([batch.column(c).to_numpy() for c in feats])
                for k, theta in thetas.items():
                    use = fold != k
                    z = np.column_stack([models[k].features_of(rows[use]), np.ones(use.sum())])
                    sign = y[use]
                    short = 1.0 - sign * (z @ theta)
                    active = short > 0
                    z, sign, short = z[active], sign[active], short[active]
                    a = np.where(sign > 0, weights[k][1], weights[k][0])
                    totals[k] += np.concatenate([((z * a[:, None]).T @ z).ravel(), z.T @ (a * sign * short), [a @ short ** 2, len(z)]])
            slot = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_pydict({"model": pa.array(list(totals), pa.int32()), "slot": pa.array([slot] * len(totals), pa.int32()),
                                              "values": pa.array(list(totals.values()), pa.list_(pa.float64()))})
        return _added(x.mapInArrow(run, schema), schema)

    ridge = np.append(np.ones(d), 0.0)  # the intercept is free
    base = {k: np.zeros(d + 1) for k in range(folds + 1)}
    trial, step, best = dict(base), {}, {}
    for _ in range(max_iter):
        if not trial:
            break
        for k, total in sums(trial).items():
            theta = trial[k]
            hessian, pull, loss = total[:(d + 1) ** 2].reshape(d + 1, d + 1), total[(d + 1) ** 2:-2], total[-2]
            value = ridge @ theta ** 2 / 2 + c_param * loss
            if k in best and value > best[k] * (1 + 1e-12):
                step[k] = step[k] / 2
            else:
                base[k], best[k] = theta, value
                slope = ridge * theta - 2 * c_param * pull
                step[k] = -np.linalg.solve(np.diag(ridge + 1e-12) + 2 * c_param * hessian, slope)
            trial[k] = base[k] + step[k]
            if np.abs(step[k]).max() <= 1e-9 * max(1.0, np.abs(base[k]).max()):
                del trial[k]
    for k, model in enumerate(models):
        model.coef, model.intercept = base[k][:d], float(base[k][d])
    return models


def train_classifier(train: DataFrame, features=FEATURE_COLUMNS, label: str = "label", c_param: float = 10.0,
                     n_components: int = 64, seed: int = 42, balanced: bool = False,
                     drop_constant: bool = True, max_iter: int = 50) -> KernelClassifier:
    """M4: the classifier of all rows of ``train`` (``fit_classifiers`` without folds)."""
    return fit_classifiers(train.withColumn("fold", F.lit(-1)), 0, features, label, c_param, n_components, seed, balanced, drop_constant, max_iter)[0]


def with_fold(df: DataFrame, id_cols: list[str], folds: int, seed: int = 42) -> DataFrame:
    """``fold`` of each row, by a hash of its id, blind to the label."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in id_cols], F.lit(seed)), F.lit(folds)).cast("int"))


def cross_validated_f1(df: DataFrame, id_cols: list[str], folds: int = 5, seed: int = 42, label: str = "label", **classifier) -> DataFrame:
    """F1 of class 1 on each fold, by the classifier that learnt from the other
    folds; one row a fold, and null where there is nothing to count.

    All folds learn in the same passes (``fit_classifiers``), and one pass scores
    every row by its fold's model."""
    x = with_fold(df, id_cols, folds, seed)
    models = fit_classifiers(x, folds, label=label, **classifier)
    feats = models[0].features

    def predict(fold: pd.Series, rows: pd.DataFrame) -> pd.Series:
        out, held, data = np.zeros(len(fold), np.int32), fold.to_numpy(), rows.to_numpy(float)
        for k in np.unique(held):
            out[held == k] = models[k].predict(data[held == k])
        return pd.Series(out)
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in feats])
    scored = x.withColumn("prediction", F.pandas_udf(predict, "int")("fold", row))
    hit = lambda a, b: F.count_if((F.col(label) == a) & (F.col("prediction") == b))
    counts = scored.groupBy("fold").agg((2 * hit(1, 1)).alias("_hit"), (2 * hit(1, 1) + hit(0, 1) + hit(1, 0)).alias("_all"))
    spine = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    return spine.join(counts, "fold", "left").select("fold", q(F.try_divide("_hit", "_all"), 4).alias("f1"))


def score(model, df: DataFrame, label_out: str = "prediction") -> DataFrame:
    """M7: whole-frame scoring; unknown feature names are 0.0."""
    for c in FEATURE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    out = model.transform(df)
    return out.withColumn(label_out, F.coalesce(F.col("prediction").cast("int"), F.lit(0)))


def save_model(model: KernelClassifier, path: str) -> str:
    """Overwrite-save a fitted model."""
    return model.save(path)


def load_model(paths: list[str]):
    """First loadable path of the candidates; ``None`` -> threshold-only mode."""
    for p in paths:
        try:
            return KernelClassifier.load(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a corrupt model is an error, a missing one is not
                raise
    return None
