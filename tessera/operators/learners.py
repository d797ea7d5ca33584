"""Base learners, out-of-fold assembly and the stacked model.

The reference's six base models map onto Spark ML estimators (distributed
training); its boosted-tree libraries, forest, elastic-net logistic
regression and 1-D convolution net become GBTClassifier, RandomForest,
LogisticRegression and a MultilayerPerceptron over the flattened window.
Early stopping with patience is ``fit_with_patience``. Leaf L1/L2 terms and leaf-count
limits, which Spark ML lacks, are in ``leafwise``; ``penalised_learners`` has them.
"""

from __future__ import annotations

import random
import threading
import uuid
from functools import reduce

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..session import ensure_checkpoint_dir
from .leafwise import LeafwiseBooster
from .ordering import join_small


#: Nodes of a forest that the driver holds at once (some hundred bytes each while trees grow).
FOREST_NODES = 200_000
_growing = threading.Lock()  # held by the group of trees that the driver holds


class InverseStrengthRegression(LogisticRegression):
    """logistic regression with inverse strength C: regParam is 1 / (C * sum of the weights)."""

    strength = 0.1

    def fit(self, dataset: DataFrame, params=None):
        w = self.getOrDefault("weightCol") if self.isDefined("weightCol") else None
        total = dataset.select(F.sum(w) if w in dataset.columns else F.count(F.lit(1))).first()[0]
        plain = self.copy({self.regParam: 1.0 / (self.strength * float(total or 1.0))})
        return LogisticRegression.fit(plain, dataset, params)


def base_learners(n_features: int, scale: float = 1.0, seed: int = C.RANDOM_STATE) -> dict:
    """Name -> unfitted estimator. ``scale`` shrinks iteration and
    tree counts (tests use small values; 1.0 is the reference's size)."""
    def it(n):
        return max(int(n * scale), 2)
    p = C.XGBOOST_PARAMS
    common = dict(featuresCol="features", labelCol="label", weightCol="weight", seed=seed)
    return {
        # primary boosted trees (colsample -> per-node feature subset)
        "XGBoost_Advanced": GBTClassifier(maxIter=it(p["n_estimators"]), stepSize=p["learning_rate"],
                                          maxDepth=p["max_depth"], subsamplingRate=p["subsample"],
                                          featureSubsetStrategy=str(p["colsample_bytree"]), **common),
        # secondary boosted trees
        "XGBoost_Secondary": GBTClassifier(maxIter=it(p["n_estimators"]), stepSize=0.02, maxDepth=6, subsamplingRate=0.9,
                                           featureSubsetStrategy=str(p["colsample_bytree"]), **common),
        # leaf-wise boosted trees (num_leaves has no Spark equivalent)
        "LightGBM": GBTClassifier(maxIter=it(400), stepSize=0.02, maxDepth=7, subsamplingRate=0.8,
                                  featureSubsetStrategy="0.8", **common),
        # random forest; a row's place in every tree is kept, so tasks do not carry the trees
        "RandomForest": RandomForestClassifier(numTrees=it(300), maxDepth=15, minInstancesPerNode=5,
                                               featureSubsetStrategy="sqrt", cacheNodeIds=True, **common),
        # elastic-net logistic regression; C = 0.1 is regParam = 1/(C*n), set from the
        # training rows by ``fit_predict``
        "LogisticRegression": InverseStrengthRegression(maxIter=it(2000), elasticNetParam=0.5,
                                                 standardization=False, featuresCol="features",
                                                 labelCol="label", weightCol="weight"),
        # neural model over the flattened window (re-aim of the 1-D conv net)
        "CNN_Medical": MultilayerPerceptronClassifier(layers=[n_features, 128, 2], maxIter=it(100),
                                                      seed=seed, featuresCol="features", labelCol="label"),
    }


def penalised_learners(scale: float = 1.0, seed: int = C.RANDOM_STATE) -> dict:
    """F1 and F3 with all their terms: leaf penalties, the weight of positive rows (F1), leaf count
    (F3). They may replace the entries of the same name in ``base_learners``."""
    def it(n):
        return max(int(n * scale), 2)
    p = C.XGBOOST_PARAMS
    common = dict(featuresCol="features", labelCol="label", seed=seed)
    return {
        # a full tree of its depth, split wherever a gain is left
        "XGBoost_Advanced": LeafwiseBooster(maxIter=it(p["n_estimators"]), stepSize=p["learning_rate"], maxDepth=p["max_depth"],
                                            numLeaves=1 << p["max_depth"], maxBins=256, subsamplingRate=p["subsample"],
                                            featureRate=p["colsample_bytree"], leafL1=p["reg_alpha"], leafL2=p["reg_lambda"], minRows=1,
                                            minCurvature=1.0, positiveWeight=float(p["scale_pos_weight"]), **common),
        "LightGBM": LeafwiseBooster(maxIter=it(400), stepSize=0.02, maxDepth=7, numLeaves=50, maxBins=255, subsamplingRate=0.8,
                                    featureRate=0.8, leafL1=0.1, leafL2=2.0, weightCol="weight", **common),
    }


def meta_learner(scale: float = 1.0, seed: int = C.RANDOM_STATE) -> GBTClassifier:
    """the stacking model (200 trees, rate 0.05, depth 4), without class weights."""
    return GBTClassifier(maxIter=max(int(200 * scale), 2), stepSize=0.05, maxDepth=4,
                         featuresCol="features", labelCol="label", seed=seed)


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """F8: balanced weights n / (k * n_class) over the k classes of the labelled rows. Rows with a
    NULL label stay, with a NULL weight. The class counts are broadcast only if they are few."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    total, k = counts.agg(F.sum("__nc"), F.count(F.lit(1))).first()
    w = counts.select(label, (F.lit(float(total or 0)) / (F.lit(float(k)) * F.col("__nc"))).alias(out))
    return join_small(df, w, label, how="left")


def positive_probability(model_df: DataFrame, out: str = "p") -> DataFrame:
    """P(class 1) from Spark ML's probability vector; invalid -> 0.5."""
    return model_df.withColumn(out, X.invalid_to(vector_to_array(F.col("probability"))[1]))


def fit_rows(df: DataFrame, least: int = 8, per_core: int = 4096, most: int = 500_000) -> DataFrame:
    """``df`` in no more partitions than a fit has use for. Every step of a fit sends a full set of
    sums (a forest: the histograms of all nodes) from every partition, whatever its rows, and
    starts a task for each: beyond ``least`` partitions and one per core with ``per_core`` rows more of
    them only add to both. A partition has at most about ``most`` rows."""
    now = df.rdd.getNumPartitions()
    if now <= least:
        return df
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, min(cores, -(-rows // per_core)), -(-rows // most)))


def fit_predict(est, train: DataFrame, test: DataFrame):
    """Fit on ``train`` and score ``test``; the MLP has no weight column."""
    tr = train if est.hasParam("weightCol") else train.drop("weight")
    model = est.fit(tr)
    return model, positive_probability(model.transform(test))


def most_nodes(est: RandomForestClassifier, rows: int) -> int:
    """Nodes that a tree of ``est`` over ``rows`` rows has at most."""
    return min(2 << est.getMaxDepth(), 2 * max(1, rows // est.getMinInstancesPerNode())) - 1


def forest_probability(est: RandomForestClassifier, train: DataFrame, test: DataFrame, key: str, nodes: int | None = None) -> DataFrame:
    """P(class 1) by a forest whose trees need not fit in the driver together.

    A forest's probability is the mean of its trees' shares, so trees are fitted in groups (each with
    a seed of its own) of about ``nodes`` nodes; a group scores ``test``, whose column ``key`` tells rows apart, and
    goes before the next is fitted. A forest that is small enough by its rows is one fit."""
    spark, nodes = test.sparkSession, nodes or FOREST_NODES
    trees, at_most = est.getNumTrees(), most_nodes(est, train.count())
    if trees * at_most <= 2 * nodes:  # trees seldom have half of their most
        return positive_probability(est.fit(train).transform(test))
    seeds = random.Random(est.getSeed())
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts: list[str] = []

    def put(votes: DataFrame) -> None:
        votes.write.parquet(f"{folder}/{put.no}")
        parts.append(f"{folder}/{put.no}")
        put.no += 1

    def total() -> DataFrame:
        return spark.read.schema(f"{key} long, no double, yes double").parquet(*parts).groupBy(key).agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    put.no = 0
    size, grown, seen = nodes // at_most, 0, 0
    while trees:
        size = min(trees, max(1, size))
        with _growing:  # concurrent fits take turns
            model = est.copy({est.numTrees: size, est.seed: seeds.randrange(1 << 31)}).fit(train)
            raw = vector_to_array(F.col("rawPrediction"))
            put(model.transform(test).select(key, raw[0].alias("no"), raw[1].alias("yes")))
            trees, grown, seen = trees - size, grown + size, seen + model.totalNumNodes
            del model
        size = min(int(nodes * grown / seen), 4 * grown)  # by the trees so far; few of them say little
        if len(parts) == 16 and trees:  # votes of earlier groups become one column
            done = list(parts)
            put(total())
            del parts[:16]
            for x in done:
                files.delete(path(x), True)
    return test.join(total(), key).withColumn("p", X.invalid_to(F.col("yes") / F.nullif(F.col("no") + F.col("yes"), F.lit(0.0))))


def patience_stop(losses: list, patience: int) -> tuple:
    """(best, stop) rounds, from 1, of a sequence of validation losses: the first smallest
    loss, and the round at which ``patience`` rounds have passed without a smaller one
    (None if the sequence ends before)."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, i + 1
    return best + 1, None


def fit_with_patience(est: GBTClassifier, train: DataFrame, valid: DataFrame, patience: int = C.XGBOOST_PARAMS["early_stopping_rounds"]) -> tuple:
    """boosted trees cut at their best validation round, as (model, history), where history
    has ``rounds`` (those looked at), ``best``, ``limit`` and the validation ``losses``.

    Rounds are grown in doubling steps until ``patience`` rounds in a row bring no smaller loss
    on ``valid`` or the learner's own limit is reached, so a learner that stops early never pays
    for all its rounds. A boosted model's first trees do not depend on how many follow (each
    round's seed is its number), so the cut model is a fit of ``best`` rounds."""
    limit = est.getMaxIter()
    rounds = min(limit, 2 * patience)
    while True:
        model = est.copy({est.maxIter: rounds}).fit(train)
        losses = [float(x) for x in model.evaluateEachIteration(valid)]
        best, stop = patience_stop(losses, patience)
        if stop is not None or rounds == limit:
            break
        rounds = min(limit, 2 * rounds)
    seen = stop or rounds
    if best < rounds:
        model = est.copy({est.maxIter: best}).fit(train)
    return model, {"rounds": seen, "best": best, "limit": limit, "losses": losses[:seen]}


def run_bounded(jobs: list, parallel: int) -> list:
    """Results of ``jobs`` (functions without arguments) in order, at most ``parallel`` at once.
    Every thread has the session's local properties, and a scheduler pool of its own where the
    session shares its cores fairly (``spark.scheduler.mode`` FAIR)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    sc = spark.sparkContext

    def named(k, job):
        def run():
            sc.setLocalProperty("spark.scheduler.pool", f"fit-{k % parallel}")
            try:
                return job()
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)
        return inheritable_thread_target(spark)(run)
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        futures = [pool.submit(named(k, j)) for k, j in enumerate(jobs)]
        return [f.result() for f in futures]


def cross_fit(df: DataFrame, estimators: dict, row_id: str = "row_id", fold: str = "fold", k: int | None = None,
              patience: int | None = None, parallel: int = 1) -> tuple:
    """E5: for every model and fold, fit on the other folds and score the held-out one. Returns
    the long table (row_id, fold, model, label, p) and the rounds table (model, fold, rounds,
    best, max_rounds, best_loss) of the learners that stop early: with ``patience``, the boosted
    trees named XGBoost, whose validation rows are the held-out fold.

    Class weights come from the training folds alone. A large forest is fitted and scored a group of
    trees after another. The input feeds models x folds fits, so it
    is written once to the shared checkpoint folder; up to ``parallel`` fits run at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df = fit_rows(df.drop("weight")).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    folds = k if k is not None else df.select(F.max(fold)).first()[0] + 1

    def job(name: str, est, i: int):
        def run():
            train, test = class_weights(df.filter(F.col(fold) != i)), df.filter(F.col(fold) == i)
            if patience and isinstance(est, GBTClassifier) and name.startswith("XGBoost"):
                model, history = fit_with_patience(est, train, test.withColumn("weight", F.lit(1.0)), patience)
                scored = positive_probability(model.transform(test))
            elif isinstance(est, RandomForestClassifier):
                scored, history = forest_probability(est, train, test, "__row"), None
            else:
                _, scored = fit_predict(est, train, test)
                history = None
            return scored.select(row_id, fold, F.lit(name).alias("model"), "label", "p"), (name, i, history)
        return run
    done = run_bounded([job(n, e, i) for i in range(folds) for n, e in estimators.items()], parallel)
    rounds = [(n, i, h["rounds"], h["best"], h["limit"], h["losses"][h["best"] - 1]) for _, (n, i, h) in done if h]
    table = spark.createDataFrame(rounds, "model string, fold int, rounds int, best int, max_rounds int, best_loss double")
    return reduce(lambda a, b: a.unionByName(b), [part for part, _ in done]), table


def out_of_fold(df: DataFrame, estimators: dict, row_id: str = "row_id", fold: str = "fold",
                k: int | None = None, parallel: int = 1) -> DataFrame:
    """E5: the predictions of ``cross_fit`` without early stopping."""
    return cross_fit(df, estimators, row_id, fold, k, parallel=parallel)[0]


def feature_importances(model, names: list | None = None) -> DataFrame:
    """long (feature, importance) from a tree model."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    names = names or [f"f{i}" for i in range(len(imp))]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")


def with_early_stopping(est: GBTClassifier, indicator: str = "is_validation", tol: float = 0.01) -> GBTClassifier:
    """F9 in Spark's own form: boosted trees stop when the loss on rows flagged ``indicator``
    stops improving by ``tol`` (``fit_with_patience`` has the reference's patience)."""
    return est.copy({est.validationIndicatorCol: indicator, est.validationTol: tol})


def learning_curve(model, train: DataFrame, valid: DataFrame) -> DataFrame:
    """Log-loss per boosting iteration on training and validation rows
    (Spark's ``evaluateEachIteration``: one distributed pass per set; the
    result has one row per iteration) and the best validation iteration."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    tr = model.evaluateEachIteration(train)
    va = model.evaluateEachIteration(valid)
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(tr, va))]
    df = spark.createDataFrame(rows, "iteration int, train_loss double, validation_loss double")
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    return df.withColumn("best_iteration", F.lit(best))
