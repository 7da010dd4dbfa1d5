"""The classifier: quality bounds against the threshold rule, folds, missing
columns, saved models; and the watchlist report."""

import inspect
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.operators import learn as L
from floodlens.operators.report import attacker_stats
from floodlens.plans.q_learn import RULE_THRESHOLD, m04, m07, m10_cv, split
from floodlens.schemas import FEATURE_COLUMNS
from floodlens.session import checkpoint_dir, materialize
from floodlens.sources import io as IO

SF = "/root/testdata/sf0.01"


def f1(scored, label="label", prediction="prediction"):
    hit = lambda a, b: F.count_if((F.col(label) == a) & (F.col(prediction) == b))
    r = scored.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn")).first()
    return 2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn)


@pytest.fixture(scope="module")
def parts(spark):
    return materialize(split(spark, SF), "split")


def test_kernel_model_reaches_the_threshold_rule(spark, parts):
    model = L.train_classifier(parts.filter("NOT is_test"), balanced=True)
    test = parts.filter("is_test")
    rule = f1(test.withColumn("prediction", (F.col("packet_rate_ewma") >= RULE_THRESHOLD).cast("int")))
    assert f1(L.score(model, test)) >= rule
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex[:8]}"
    assert L.load_model([path]) is None  # nothing there: threshold-only
    L.save_model(model, path)
    assert f1(L.score(L.load_model([f"{path}-missing", path]), test)) == f1(L.score(model, test))
    broken = f"{path}-broken"
    spark.range(1).write.parquet(f"{broken}/rff")
    with pytest.raises(Exception):  # there, but unreadable
        L.load_model([broken])


def test_missing_features_are_named(spark):
    with pytest.raises(ValueError, match="missing feature columns: is_to_victim, .*inter_arrival_std"):
        L.train_classifier(spark.createDataFrame([(1, 0.5)], "label int, packet_rate_ewma double"))


def numpy_machine(x, y, model, c_param, balanced):
    """The squared-hinge machine on the same random features, by plain gradient of the whole data and scipy-free Newton."""
    z = np.column_stack([model.features_of(x), np.ones(len(x))])
    sign = np.where(y == 1, 1.0, -1.0)
    a = np.array([len(y) / (len(set(y.tolist())) * (y == v).sum()) for v in y]) if balanced else np.ones(len(y))
    theta, ridge = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0.0)

    def value(t):
        return ridge @ t ** 2 / 2 + c_param * (a @ np.maximum(0, 1 - sign * (z @ t)) ** 2)
    for _ in range(100):
        short = np.maximum(0, 1 - sign * (z @ theta))
        on = short > 0
        slope = ridge * theta - 2 * c_param * z.T @ (a * sign * short)
        step = -np.linalg.solve(np.diag(ridge + 1e-12) + 2 * c_param * (z[on] * a[on, None]).T @ z[on], slope)
        size = 1.0
        while value(theta + size * step) > value(theta) and size > 1e-12:
            size /= 2
        theta = theta + size * step
    return theta


@pytest.mark.parametrize("balanced", [True, False])
def test_fit_and_margins_equal_numpy(spark, parts, balanced):
    train = parts.filter("NOT is_test")
    model = L.train_classifier(train, balanced=balanced, n_components=16)
    rows = parts.toPandas()
    x, y = rows[list(FEATURE_COLUMNS)].to_numpy(float), rows["label"].to_numpy()
    held = rows["is_test"].to_numpy(bool)
    kept = [j for j in range(x.shape[1]) if x[~held, j].std() > 0]
    assert model.kept.tolist() == kept
    assert np.allclose(model.mean, x[~held][:, kept].mean(0)) and np.allclose(model.std, x[~held][:, kept].std(0, ddof=1))
    theta = numpy_machine(x[~held], y[~held], model, 10.0, balanced)
    assert np.allclose(np.append(model.coef, model.intercept), theta, rtol=1e-5, atol=1e-6)
    scored = L.score(model, parts).select("src_ip", "dst_ip", "window_end_us", "margin", "prediction").toPandas()
    both = rows.assign(want=np.sqrt(2 / 16) * np.cos((x[:, kept] - model.mean) / model.std @ model.w.T + model.b) @ model.coef + model.intercept).merge(scored)
    assert len(both) == len(rows) and np.allclose(both.margin, both.want, atol=1e-9)
    assert ((both.want > 0) == (both.prediction == 1)).all()


def test_saved_model_scores_the_same_to_the_bit(spark, parts):
    model = L.train_classifier(parts.filter("NOT is_test"), balanced=True, n_components=16)
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex[:8]}"
    L.save_model(model, path)
    L.save_model(model, path)  # overwrites
    x = np.random.default_rng(1).normal(size=(50, 7)) * 10
    assert (L.load_model([path]).margins(x) == model.margins(x)).all()


def test_folds_learn_in_one_go_what_they_learn_alone(spark, parts):
    x = L.with_fold(parts, ["src_ip", "dst_ip", "window_end_us"], 3)
    together = L.fit_classifiers(x, 3, balanced=True, n_components=16)
    for k, model in enumerate(together):
        alone = L.train_classifier(x.filter(F.col("fold") != k).drop("fold"), balanced=True, n_components=16)
        assert np.allclose(alone.coef, model.coef, rtol=1e-6, atol=1e-8) and abs(alone.intercept - model.intercept) < 1e-6


def test_cross_validated_f1_by_hand(spark, parts):
    ids = ["src_ip", "dst_ip", "window_end_us"]
    got = {r.fold: r.f1 for r in L.cross_validated_f1(parts, ids, folds=3, balanced=True, n_components=16).collect()}
    x = L.with_fold(parts, ids, 3)
    models = L.fit_classifiers(x, 3, balanced=True, n_components=16)
    seen = 0
    for k in range(3):
        rows = x.filter(F.col("fold") == k).toPandas()
        pred, y = models[k].predict(rows[list(FEATURE_COLUMNS)].to_numpy(float)), rows["label"].to_numpy()
        tp, wrong = ((pred == 1) & (y == 1)).sum(), (pred != y).sum()
        assert got[k] == pytest.approx(2 * tp / (2 * tp + wrong), abs=1e-4)
        seen += len(rows)
    assert seen == parts.count() and set(got) == {0, 1, 2}


def test_odd_training_rows(spark):
    kind = "label int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    rows = [(k % 2, 1.0, float(k % 2), 3.0, float(k), 5.0, None if k == 7 else 6.0 + k, 0.0) for k in range(40)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], kind)
    model = L.train_classifier(df)
    assert model.kept.tolist() == [1, 3, 5]  # the others are constant
    scored = L.score(model, df.withColumn("margin", F.lit("x"))).collect()
    assert all(r.prediction == r.label for r in scored[:40] if r.pkt_size_std is not None) and scored[7].prediction == 0 and scored[7].margin is None
    one_class = L.train_classifier(df.filter("label = 1"), balanced=True)
    assert {r.prediction for r in L.score(one_class, df.limit(5)).collect()} == {1}
    nothing = L.train_classifier(df.limit(0))
    assert {r.prediction for r in L.score(nothing, df).collect()} == {0}
    assert L.cross_validated_f1(df.limit(0), ["label"], folds=2).collect() == [(0, None), (1, None)]


def test_every_model_query_fits_the_same_classifier(spark, monkeypatch):
    fitted = []
    fit_classifiers = L.fit_classifiers

    def fit(rows, folds, *args, **kwargs):
        call = inspect.signature(fit_classifiers).bind(rows, folds, *args, **kwargs)
        call.apply_defaults()
        fitted.append({k: v for k, v in call.arguments.items() if k not in ("rows", "folds")} | {"folds": folds})
        return [L.KernelClassifier(FEATURE_COLUMNS, [0], [0.0], [1.0], [[1.0]], [0.0], [0.0], 0.0)] * (folds + 1)
    monkeypatch.setattr(L, "fit_classifiers", fit)
    for query in (m04, m07, m10_cv):
        query(spark, SF)
    assert [f.pop("folds") for f in fitted] == [0, 0, 5] and all(f == fitted[0] for f in fitted)
    assert (fitted[0]["c_param"], fitted[0]["balanced"], fitted[0]["n_components"], fitted[0]["max_iter"]) == (10.0, True, 64, 50)


def test_silent_watchlist_sources_have_null_rows(spark):
    det = spark.createDataFrame([("a", 1, "WARNING", 2.0)], "src_ip string, ts_us long, detection_status string, packet_rate double")
    got = {r.src_ip: (r.first_warn_us, r.total_pkts) for r in attacker_stats(det, watch=["a", "b"]).collect()}
    assert got == {"a": (1, 1), "b": (None, None)}


def test_missing_log_reads_as_an_empty_table(spark):
    missing = os.path.join(checkpoint_dir(spark), f"never-written-{uuid.uuid4().hex[:8]}")
    assert IO.read_event_log(spark, missing).count() == 0
