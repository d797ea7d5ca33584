"""The whole training job from a raw panel, reports that fail apart, sketches."""
import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import clean, sketches, splits, temporal, windows
from tessera.plans import pipeline
from tessera.sources import fixtures as fx
from tessera.sources import io

COMMON = dict(featuresCol="features", labelCol="label", weightCol="weight")


def test_job_from_panel_to_published_model(spark, scratch):
    panel = fx.panel_short(spark, SF)
    ests = {f"m{i}": LogisticRegression(maxIter=3, regParam=0.1 * (i + 1), **COMMON) for i in range(5)}
    ests["XGBoost_Advanced"] = GBTClassifier(maxIter=4, maxDepth=2, seed=1, **COMMON)
    job = pipeline.training_job(panel, learners=ests, scale=0.01, patience=2, parallel=3, publish_to=f"{scratch}/models")
    test = splits.take_split(panel, "patient_id", "test")
    scored = job["test"].collect()
    assert sorted(r.row_id for r in scored) == sorted(r.patient_id for r in test.select("patient_id").distinct().collect())
    got = {(r.part, r.model, r.metric): r.value for r in job["metrics"].collect()}
    y, p = np.array([r.y for r in scored]), np.array([r.probability for r in scored])
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(got["test", "Ensemble", "AUROC"] - np.mean(pairs)) < 1e-9
    for t in (0.1, 0.2, 0.3, 0.5):
        assert abs(got["test", "Ensemble", f"Sens_@{t}"] - (p[y == 1] >= t).mean()) < 1e-12
        assert abs(got["test", "Ensemble", f"Spec_@{t}"] - (p[y == 0] < t).mean()) < 1e-12
    assert {m for part, m, k in got if part == "train" and k == "cv_auc"} == set(ests) and ("train", "Ensemble", "train_auc") in got
    assert [r.model for r in job["rounds"].collect()] == ["XGBoost_Advanced"] * 3
    # no entity in two folds, none of the held-out ones in any
    folds = job["oof"].groupBy("row_id").agg(F.countDistinct("fold").alias("n")).collect()
    assert {r.n for r in folds} == {1} and not {r.row_id for r in folds} & {r.row_id for r in scored}
    # the published model scores raw rows as the job did
    saved = io.load_published(spark, f"{scratch}/models")
    again = {r.patient_id: r.probability for r in pipeline.score_panel(saved, test.drop("label")).collect()}
    assert again == {r.row_id: r.probability for r in scored} and job["version"] == 1


def test_an_empty_side_raises(spark):
    panel = fx.panel_short(spark, SF)
    try:
        pipeline.training_job(panel, test_size=0.0)
        raise AssertionError("not reached")
    except ValueError as e:
        assert "empty" in str(e)


def test_a_failing_report_leaves_the_others(spark, scratch):
    tables = {"a": spark.range(7), "b": lambda: spark.range(3).select(F.raise_error(F.lit("no"))), "c": lambda: 1 / 0, "d": lambda: spark.range(0)}
    status = io.write_reports_apart(tables, scratch, parallel=2)
    assert [s[:3] for s in status] == [("a", True, 7), ("b", False, None), ("c", False, None), ("d", True, 0)]
    assert "division" in status[2][3] and spark.read.parquet(f"{scratch}/a").count() == 7
    assert [r.name for r in io.write_status(spark, status, scratch).where("ok").collect()] == ["a", "d"]


def test_a_forest_scores_after_scans_and_reports(spark, scratch):
    from pyspark.ml.classification import RandomForestClassifier
    panel = fx.panel_hot(spark, SF)
    assert io.write_reports_apart({"scan": temporal.temporal_features(panel)}, scratch)[0][1:3] == (True, panel.count())
    rows = window_rows(panel)
    model = RandomForestClassifier(numTrees=3, seed=1, featuresCol="features", labelCol="label").fit(rows)
    assert model.transform(rows).where("prediction in (0.0, 1.0)").count() == rows.count()


def window_rows(panel):
    from pyspark.ml.functions import array_to_vector
    return panel.select(array_to_vector(F.array(F.coalesce("hr", F.lit(0.0)), F.coalesce("temp", F.lit(0.0)))).alias("features"),
                        F.col("label").cast("double").alias("label"))


def test_sketches_stand_in_for_exact_statistics(spark):
    rng = np.random.default_rng(3)
    x, part = rng.normal(size=20_000), rng.integers(0, 9, 20_000)
    df = spark.createDataFrame([(int(p), float(v), None) for p, v in zip(part, x, strict=True)], "part_no int, a double, b double")
    stored = sketches.part_sketches(df, "part_no", ["a", "b"])
    assert stored.count() == 9
    one = sketches.merged(stored)
    rank = lambda v: (x <= v).mean()
    for r in sketches.sketch_quantiles(one, [0.1, 0.5, 0.9]).collect():
        assert abs(rank(r["value"]) - r["prob"]) < 0.01 and r["n"] == 20_000
    assert abs(sketches.sketch_distincts(one).first()["distinct"] / 20_000 - 1) < 0.06
    medians = sketches.sketch_medians(one)
    assert list(medians) == ["a"] and abs(rank(medians["a"]) - 0.5) < 0.01
    few = spark.createDataFrame([(None, None), (1.0, 2.0)], "a double, b double")
    assert clean.median_fill(few, ["a", "b"], medians=medians).first() == (medians["a"], 0.0)
    exact = windows.robust_scaler_fit(df, ["a"]).first()
    approx = sketches.sketch_scaler(one).first()
    assert abs(approx["center"] - exact["center"]) < 0.05 and abs(approx["scale"] / exact["scale"] - 1) < 0.05
