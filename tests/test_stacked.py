"""Training, saving, loading and scoring the stacked model; class weights and correlations with NULLs."""
import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import learners, meta, reports
from tessera.plans import pipeline
from tessera.sources import io


def test_loaded_model_scores_like_the_fitted_one(spark, scratch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
        (F.col("label") < 5).cast("int").alias("label"))
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    ests = {f"m{i}": LogisticRegression(maxIter=3, regParam=0.1 * (i + 1), **common) for i in range(6)}
    fitted = pipeline.train_stacked(df, learners=ests, scale=0.02)
    io.save_models(fitted, scratch)
    loaded = io.load_models(spark, scratch)
    score = lambda f: sorted(map(str, pipeline.score_stacked(f, df.drop("label")).collect()))
    assert score(loaded) == score(fitted) and len(score(loaded)) == df.count()
    assert [r.name for r in io.model_info(spark, scratch).orderBy("position").collect()] == [*ests, "ensemble"]


def test_training_shares_with_heavy_ties(spark):
    train = spark.createDataFrame([("m", 0.1)] * 90 + [("m", 0.5)] * 5 + [("m", 0.9)] * 5, "model string, p double")
    asked = spark.createDataFrame([("m", x) for x in (0.1, 0.5, 0.9, 0.7, 1.0, 0.0)], "model string, p double")
    got = {r.p: r.share for r in meta.training_shares(meta.score_counts(train), asked).collect()}
    assert got == {0.1: 0.0, 0.5: 0.9, 0.9: 0.95, 0.7: 0.95, 1.0: 1.0, 0.0: 0.0}


def test_class_weights_keep_null_labels(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (2,), (None,)], "label int")
    got = sorted(((r.label, r.weight) for r in learners.class_weights(df).collect()), key=str)
    assert got == sorted([(0, 4 / 6), (0, 4 / 6), (1, 4 / 3), (2, 4 / 3), (None, None)], key=str)


def test_correlations_are_pairwise(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 5.0, None), (4.0, 3.0, 1.0), (5.0, 1.0, 2.0)]
    got = {(r.a, r.b): r.r for r in reports.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1]) < 1e-12
    assert abs(got["c", "a"] - np.corrcoef([3.0, 1.0, 2.0], [2.0, 4.0, 5.0])[0, 1]) < 1e-12


def test_lookup_equals_the_merged_shares(spark):
    import random
    rng = random.Random(2)
    train = [(m, round(rng.random(), 2) if m == "a" else rng.random()) for m in "ab" for _ in range(900)] + [("a", 0.5)] * 700
    index_of = meta.score_counts(spark.createDataFrame(train, "model string, p double"))
    index = meta.rank_index(index_of, ["a", "b", "none"], per_bucket=20)
    assert len(index["splits"]["b"]) > 20
    asked = [(i, rng.choice([0.0, 1.0, 0.5, round(rng.random(), 2), rng.random(), train[rng.randrange(900)][1]]),
              rng.choice([rng.random(), train[900 + rng.randrange(900)][1]]), 0.3) for i in range(400)]
    got = meta.lookup_ranks(spark.createDataFrame(asked, "id int, a_pred double, b_pred double, none_pred double"), index, ["a", "b", "none"]).collect()
    assert len(got) == 400
    below = lambda m, q: sum(p < q for k, p in train if k == m) / sum(k == m for k, _ in train)
    for r in got:
        assert (r.a_rank, r.b_rank, r.none_rank) == (below("a", r.a_pred), below("b", r.b_pred), 0.0)
