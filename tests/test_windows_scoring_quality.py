import pytest
from pyspark.sql import functions as F

from tessera.config import PanelSpec
from tessera.operators import quality, scoring, splits, windows

SPEC = PanelSpec(tie=None)


def test_padding_short_equal_long_histories(spark):
    rows = [(1, h, float(h)) for h in range(3)] + [(2, h, float(h)) for h in range(6)] + \
           [(3, h, float(h)) for h in range(9)]
    df = spark.createDataFrame(rows, "patient_id long, hour int, hr double")
    long = windows.pad_front(windows.last_rows(df, SPEC), SPEC, ["hr"])
    got = {(r.patient_id, r.step): (r.hr, r.is_pad) for r in long.collect()}
    assert len(got) == 18
    assert got[(1, 0)] == (0.0, True) and got[(1, 3)] == (0.0, False) and got[(1, 5)] == (2.0, False)
    assert got[(3, 0)] == (3.0, False) and got[(3, 5)] == (8.0, False)
    arr = windows.window_arrays(long, SPEC, ["hr"]).filter("patient_id = 1").first().window
    assert arr == [[0.0], [0.0], [0.0], [0.0], [1.0], [2.0]]


def test_zero_iqr_scales_by_one(spark):
    df = spark.createDataFrame([(i, 0, 5.0, float(i)) for i in range(4)], "patient_id long, step int, c double, d double")
    st = {r.feature: (r.center, r.scale) for r in windows.robust_scaler_fit(df, ["c", "d"]).collect()}
    assert st["c"] == (5.0, 1.0)
    assert st["d"] == (1.5, 1.5)


@pytest.mark.parametrize("n,f", [(5, 1), (6, 1), (12, 2), (13, 3)])
def test_reshape_flat_widths(spark, n, f):
    df = spark.createDataFrame([([float(i) for i in range(n)],)], "values array<double>")
    w = scoring.reshape_flat(df, "values").first()
    assert w.features_per_step == f and len(w.window) == 6 and all(len(r) == f for r in w.window)
    flat = [x for r in w.window for x in r]
    assert flat[:n] == [float(i) for i in range(n)] and all(x == 0.0 for x in flat[n:])


def test_explanations(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.9)], "row_id long, a double, b double, c double")
    s = scoring.explain_summary(df, ["a", "b", "c"], ["row_id"]).first()
    assert s.most_influential == "c" and s.agreement_level == "Low"
    conf = df.select(scoring.confidence(["a", "b", "c"]).alias("c")).first().c
    assert conf == pytest.approx(1 - 0.35590260840104376)
    single = df.select(scoring.confidence(["a"]).alias("c")).first().c
    assert single == 0.8


def test_input_checks_flags(spark):
    df = spark.createDataFrame([([[1.0, float("nan")], [2.0, 3.0]],), ([[1.0], [2.0, 3.0]],),
                                ([[1.0, float("inf")], [2.0, 3.0]],)], "features array<array<double>>")
    r = quality.input_checks(df, steps=2).collect()
    assert r[0].has_nan and not r[0].is_valid
    assert not r[1].shape_ok
    assert r[2].has_inf


def test_imbalance_two_classes_only(spark):
    df = spark.createDataFrame([(0,)] * 20 + [(1,)], "label int")
    r = quality.class_imbalance(df).first()
    assert r.imbalance_ratio == pytest.approx(0.05) and r.severe
    one = quality.class_imbalance(spark.createDataFrame([(0,)] * 3, "label int")).first()
    assert one.imbalance_ratio is None and not one.severe


def test_group_folds_disjoint_and_split_deterministic(spark):
    df = spark.range(0, 2000).select((F.col("id") % 97).alias("e"), "id")
    f = splits.group_folds(df, "e", 5)
    assert f.groupBy("e").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    a = splits.holdout_split(df, "e").select("e", "split").distinct().collect()
    b = splits.holdout_split(df, "e").select("e", "split").distinct().collect()
    assert sorted(a) == sorted(b)
    share = sum(1 for r in a if r.split == "test") / 97
    assert 0.05 < share < 0.4


def test_stratified_folds_balance(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    f = splits.stratified_folds(df, "y", "id", 5)
    per = f.groupBy("fold").agg(F.sum("y").alias("pos")).collect()
    assert {r.pos for r in per} == {20}


def test_learning_curve_and_early_stopping(spark):
    from pyspark.ml.linalg import Vectors
    from tessera.operators import learners
    rows = [(i, Vectors.dense([float(i % 7), float(i % 3)]), float(i % 7 > 3), 1.0, i % 4 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, ["row_id", "features", "label", "weight", "is_validation"])
    est = learners.base_learners(2, scale=0.02)["XGBoost_Advanced"]
    m = est.fit(df.filter(~F.col("is_validation")))
    lc = learners.learning_curve(m, df.filter(~F.col("is_validation")), df.filter("is_validation")).collect()
    assert len(lc) == m.getNumTrees and lc[0].train_loss >= lc[-1].train_loss
    es = learners.with_early_stopping(est).fit(df)
    assert es.getNumTrees <= est.getMaxIter()
