import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import meta, metrics, reports


def _long(spark, y, p, model="m"):
    return spark.createDataFrame([(i, model, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "row_id long, model string, y int, p double")


def _brute_auc(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum(1.0 if x > z else 0.5 if x == z else 0.0 for x in pos for z in neg)
    return s / (len(pos) * len(neg))


def _ap(y, p):
    order = np.argsort(-np.array(p), kind="mergesort")
    ys, ps = np.array(y)[order], np.array(p)[order]
    out, tp, fp, P = 0.0, 0, 0, sum(y)
    i = 0
    while i < len(ps):
        j = i
        while j < len(ps) and ps[j] == ps[i]:
            j += 1
        dtp = int(ys[i:j].sum())
        tp += dtp
        fp += (j - i) - dtp
        out += dtp / P * tp / (tp + fp)
        i = j
    return out


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.random(500) * 0.6 + 0.4 * y, 1)  # heavy ties
    r = metrics.auc_table(_long(spark, y, p)).first()
    assert abs(r.auroc - _brute_auc(y, p)) < 1e-12
    assert abs(r.auprc - _ap(y, p)) < 1e-12


def test_auc_matches_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    p = rng.random(300)
    df = _long(spark, y, p)
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0)
    ref = ev.evaluate(df.withColumn("label", F.col("y").cast("double")))
    assert abs(metrics.auc_table(df).first().auroc - ref) < 1e-9


def test_one_class_gives_null_auc(spark):
    r = metrics.auc_table(_long(spark, [1, 1, 1], [0.2, 0.5, 0.9])).first()
    assert r.auroc is None


def test_confusion_and_rates(spark):
    y = [1, 0, 1, 0, 1, 0]
    p = [0.0, 0.3, 0.5, 0.7, 0.8, 1.0]
    r = {x.t: x for x in metrics.rates(metrics.confusion(_long(spark, y, p), [0.5])).collect()}[0.5]
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 2, 1, 1)
    assert r.sensitivity == pytest.approx(2 / 3) and r.specificity == pytest.approx(1 / 3)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = reports.histogram(df, "x", [], 30).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=30)
    assert [r["count"] for r in h] == list(counts)
    assert np.allclose([r.lo for r in h], edges[:-1])
    const = spark.createDataFrame([(2.0,), (2.0,), (2.0,)], "x double")
    hc = reports.histogram(const, "x", [], 10).collect()
    c2, e2 = np.histogram([2.0, 2.0, 2.0], bins=10)
    assert sorted(r["count"] for r in hc) == sorted(c2)


def test_decision_bins_exclude_one(spark):
    df = _long(spark, [1, 0, 1], [1.0, 0.0, 0.99])
    t = {r.bin: r for r in reports.decision_bins(df).collect()}
    assert len(t) == 20 and t[0]["count"] == 1 and t[19]["count"] == 1


def test_calibration_right_closed(spark):
    df = _long(spark, [0, 1, 1], [0.3, 0.30000000000000004, 1.0])
    got = {r.bin: r["count"] for r in metrics.calibration(df).collect()}
    # numpy: searchsorted(linspace(0,1,11)[1:-1], p) -> 2, 2 and 9
    assert got == {2: 2, 9: 1}


def test_meta_width_and_row_stats(spark):
    rows = [(i, i % 2, *[float(((i + 1) * (k + 3)) % 11) / 10 for k in range(6)]) for i in range(50)]
    cols = ["row_id", "y"] + [f"m{k}" for k in range(6)]
    df = spark.createDataFrame(rows, cols)
    m = meta.meta_features(df, [f"m{k}" for k in range(6)])
    assert len(m.columns) == 51 + 2
    r = m.orderBy("row_id").first()
    v = np.array(rows[0][2:])
    assert r.ensemble_std == pytest.approx(v.std())
    assert r.ensemble_median == pytest.approx(np.median(v))
    assert r.disagreement == pytest.approx(np.abs(v - v.mean()).mean())
    with pytest.raises(ValueError):
        meta.meta_features(df, ["m0", "m1"])
