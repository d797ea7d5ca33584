"""Early stopping with patience, concurrent fits, logistic regression's strength."""
import threading

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import learners as L
from tessera.operators import splits

COMMON = dict(featuresCol="features", labelCol="label", weightCol="weight")


def rows_of(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = F.transform(F.slice("embedding", 1, 12), lambda v: v.cast("double"))
    d = e.select(F.col("vec_id").alias("row_id"), array_to_vector(x).alias("features"), (F.col("label") < 5).cast("double").alias("label"))
    return splits.stratified_folds(d, "label", "row_id", 2)


def test_patience_of_fifty_rounds():
    falling = [1.0 - 0.001 * i for i in range(100)]
    flat = falling + [0.95] * 400
    assert L.patience_stop(flat, 50) == (100, 150)
    assert L.patience_stop(falling, 50) == (100, None)
    assert L.patience_stop(flat[:149], 50) == (100, None)
    late = falling + [0.95] * 49 + [0.5] + [0.6] * 50  # a smaller loss in the last round of patience
    assert L.patience_stop(late, 50) == (150, 200)
    assert L.patience_stop([0.3, 0.3, 0.3], 2) == (1, 3) and L.patience_stop([0.3], 1) == (1, None)


def test_model_is_cut_at_its_best_round(spark):
    d = L.class_weights(rows_of(spark))
    train, valid = d.where("fold = 0"), d.where("fold = 1")
    est = GBTClassifier(maxIter=16, stepSize=0.01, maxDepth=2, seed=3, subsamplingRate=0.8, **COMMON)
    full = est.fit(train)
    losses = list(full.evaluateEachIteration(valid))
    model, h = L.fit_with_patience(est, train, valid, patience=3)
    best, stop = L.patience_stop(losses, 3)
    assert (h["best"], h["rounds"], h["limit"]) == (best, stop or 16, 16) and h["losses"] == losses[:h["rounds"]]
    shape = lambda trees: [t.toDebugString.split("\n", 1)[1] for t in trees]
    assert model.getNumTrees == best and shape(model.trees) == shape(full.trees[:best])


def test_parallel_fits_equal_serial_ones(spark):
    d = rows_of(spark)
    ests = {"XGBoost_Advanced": GBTClassifier(maxIter=6, stepSize=0.5, maxDepth=2, seed=1, **COMMON),
            "RandomForest": RandomForestClassifier(numTrees=5, seed=1, **COMMON), "LogisticRegression": LogisticRegression(maxIter=5, **COMMON)}
    serial, rounds = L.cross_fit(d, ests, k=2, patience=2)
    several, again = L.cross_fit(d, ests, k=2, patience=2, parallel=4)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(serial) == key(several) and key(rounds) == key(again)
    assert len(key(rounds)) == 2 and serial.count() == 3 * d.count()
    assert all(r.best <= r.rounds <= r.max_rounds and (r.rounds == r.max_rounds or r.rounds - r.best == 2) for r in rounds.collect())


def test_jobs_are_bounded_and_keep_their_order(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def job(i):
        def run():
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            spark.range(1000).count()
            with lock:
                now[0] -= 1
            return i
        return run
    assert L.run_bounded([job(i) for i in range(9)], 3) == list(range(9)) and 1 < most[0] <= 3


def test_strength_follows_the_rows(spark):
    d = L.class_weights(rows_of(spark))
    est = L.base_learners(12, scale=0.05)["LogisticRegression"]
    n = d.agg(F.sum("weight")).first()[0]
    twin = LogisticRegression(maxIter=est.getMaxIter(), elasticNetParam=0.5, regParam=1 / (0.1 * n), standardization=False, **COMMON)
    assert est.fit(d).coefficients == twin.fit(d).coefficients
