"""Registered queries: the fitted classifier in the detector, in batch and in the
stream (P17, ST2), and checks of the model itself (M4, M7, S10) whose SQL twins
count the rows that must agree.

The classifier of every query here is m04's: fitted on the train split of the
flow features, saved, and loaded again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators import learn as L
from floodlens.plans.detector import detector, sql_attack_slice, sql_prelude
from floodlens.plans.fixture import ALL_SOURCES, CHUNK_S, FIXTURE_TH as TH
from floodlens.plans.q_learn import CLASSIFIER, DS_SQL, split
from floodlens.plans.q_stream import _slice_stream
from floodlens.plans.registry import register
from floodlens.session import checkpoint_dir, materialize
from floodlens.sources.adapter import packets
from floodlens.streaming.detector import detector_stream
from floodlens.streaming.source import run_available_now

STATES = ("pkt_id", "final_prediction", "detection_status", "warning_since_us", "alert_first_seen_us", "trigger")
#: margins and gradients that differ by more than this, relative to their size, differ
TOLERANCE = 1e-7


def fitted(spark, rows: DataFrame) -> str:
    """The folder of the classifier fitted on the train rows."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/floodlens-models/kernel-svm-{uuid.uuid4().hex[:12]}"
    return L.save_model(L.train_classifier(rows.filter(~F.col("is_test")), **CLASSIFIER), path)


def _model(spark, sf):
    path = fitted(spark, materialize(split(spark, sf), "split"))
    return L.load_model([f"{path}-missing", path])


def with_terms(rows: DataFrame, path: str) -> DataFrame:
    """The saved model in Spark's own expressions: ``_z`` (random features and the
    constant 1) and ``_margin`` of each row, from the one row of the model's table."""
    model = rows.sparkSession.read.parquet(f"{path}/rff")
    names = model.first()["features"]
    values = F.array(*[F.col(c).cast("double") for c in names])
    x = rows.crossJoin(F.broadcast(model.select(*[F.col(c).alias(f"_{c}") for c in model.columns])))  # one row
    x = x.withColumn("_scaled", F.zip_with(F.zip_with(F.transform("_kept", lambda k: values[k.cast("int")]), F.col("_mean"), lambda v, m: v - m),
                                           F.col("_std"), lambda v, s: v / s))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    z = F.zip_with("_w", "_b", lambda w, b: F.sqrt(F.lit(2.0) / F.size("_b")) * F.cos(dot(w, F.col("_scaled")) + b))
    x = x.withColumn("_z", F.concat(z, F.array(F.lit(1.0)))).withColumn("_theta", F.concat("_coef", F.array("_intercept")))
    return x.withColumn("_margin", dot(F.col("_z"), F.col("_theta")))


@register("p17_classifier_prediction")
def p17_classifier(spark, sf):
    """P17 in batch with the fitted classifier: final prediction and detection state of every packet of the slice."""
    return detector(packets(spark, sf), TH, ALL_SOURCES, CHUNK_S, model=_model(spark, sf)).select(*STATES)


@register("st02_model_stream")
def st02_model(spark, sf):
    """ST2 with the fitted classifier in the state machine."""
    det = detector_stream(_slice_stream(spark, sf), TH, model=_model(spark, sf), victim=ALL_SOURCES.victim)
    return run_available_now(det, "st02-model").select(*STATES)


@register("st02_model_agreement", f"""WITH {sql_prelude()}, {sql_attack_slice(ALL_SOURCES)}
SELECT count(*) AS n, 0 AS differing FROM sl""")
def st02_agreement(spark, sf):
    """Rows of the slice, and those on which stream and batch with the same fitted classifier differ: none."""
    model = _model(spark, sf)
    det = detector_stream(_slice_stream(spark, sf), TH, model=model, victim=ALL_SOURCES.victim)
    stream = run_available_now(det, "st02-model").select("pkt_id", F.struct(*STATES).alias("s"))
    batch = detector(packets(spark, sf), TH, ALL_SOURCES, CHUNK_S, model=model).select("pkt_id", F.struct(*STATES).alias("b"))
    return stream.join(batch, "pkt_id", "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("s").eqNullSafe(F.col("b"))).cast("int").alias("differing"))


@register("m07_margin_agreement", DS_SQL + """
SELECT count(*) AS n, 0 AS differing FROM spl""")
def m07_agreement(spark, sf):
    """Rows scored, and those whose margin or prediction by the fitted model's matrix
    products differs from the saved model's in Spark's own expressions: none (M7, S10)."""
    sp = materialize(split(spark, sf), "split")
    path = fitted(spark, sp)
    scored = with_terms(L.score(L.load_model([path]), sp), path)
    off = F.abs(F.col("margin") - F.col("_margin")) > TOLERANCE * (1 + F.abs("_margin"))
    wrong = (F.col("prediction") == 1) != (F.col("_margin") > 0)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(off | wrong, F.lit(True))).cast("int").alias("differing"))


@register("m04_optimality", DS_SQL + """
SELECT count(*) AS n, 65 AS parameters, 0 AS not_stationary FROM spl WHERE NOT is_test""")
def m04_optimality(spark, sf):
    """The loss is convex, so the fit is the best one where its gradient over all
    train rows is zero: rows, parameters, and parameters with a slope (none)."""
    sp = materialize(split(spark, sf), "split")
    path = fitted(spark, sp)
    train = sp.filter(~F.col("is_test"))
    weights = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = weights.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weights = weights.crossJoin(F.broadcast(total)).select("label", (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("_a"))
    x = with_terms(train.join(F.broadcast(weights), "label"), path)  # two classes
    y = 2.0 * F.col("label") - 1.0
    pull = 2.0 * CLASSIFIER["c_param"] * F.col("_a") * y * F.greatest(F.lit(0.0), 1.0 - y * F.col("_margin"))
    terms = x.select("_theta", F.posexplode(F.transform("_z", lambda z: z * pull)).alias("place", "pull"))
    slopes = terms.groupBy("place").agg(F.sum("pull").alias("pull"), F.sum(F.abs("pull")).alias("size"), F.first("_theta").alias("t"), F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("place") < F.size("t") - 1, F.get("t", F.col("place"))).otherwise(0.0)
    off = F.abs(own - F.col("pull")) > TOLERANCE * (1 + F.col("size"))
    return slopes.agg(F.max("n").alias("n"), F.count(F.lit(1)).cast("int").alias("parameters"), F.count_if(off).cast("int").alias("not_stationary"))
