"""Entity-level splits and folds.

Hash-based assignments are a pure function of the key: no join, no shuffle,
the same on every run and every executor. Rank-based assignments (balanced
folds) use the distributed ``ordinal_rank`` on the distinct keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .ordering import ordinal_rank


def distinct_entities(df: DataFrame, entity: str) -> DataFrame:
    """Distinct entity ids."""
    return df.select(entity).distinct()


def split_expr(entity: str, test_size: float = C.TEST_SIZE, seed: int = C.RANDOM_STATE) -> F.Column:
    """E1: 'test' for about ``test_size`` of the entities, else 'train';
    whole entities, deterministic (the first 8 hex digits of the md5 of "seed_id")."""
    digest = F.md5(F.concat(F.lit(f"{seed}_"), F.coalesce(F.col(entity).cast("string"), F.lit(""))))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return F.when(bucket < F.lit(int(round(test_size * 10_000))), "test").otherwise("train")


def holdout_split(df: DataFrame, entity: str, test_size: float = C.TEST_SIZE,
                  seed: int = C.RANDOM_STATE) -> DataFrame:
    """E1 + E2: tag rows with their entity's split."""
    return df.withColumn("split", split_expr(entity, test_size, seed))


def take_split(df: DataFrame, entity: str, which: str, test_size: float = C.TEST_SIZE,
               seed: int = C.RANDOM_STATE) -> DataFrame:
    """Membership filter - rows of the entities in split ``which``
    (a filter on the key's hash: no semi-join needed)."""
    return df.filter(split_expr(entity, test_size, seed) == F.lit(which))


def check_nonempty(train: DataFrame, test: DataFrame) -> None:
    """Both sides must hold rows."""
    if train.isEmpty() or test.isEmpty():
        raise ValueError("Train or test split is empty")


def group_folds(df: DataFrame, entity: str, k: int = C.CV_FOLDS, method: str = "rank") -> DataFrame:
    """Fold per entity, no entity in two folds. ``rank``: balanced,
    (position of the entity in id order) mod k - the distinct ids are
    ranked distributed and joined back; ``hash``: pmod(xxhash64(id), k),
    no join at all."""
    if method == "hash":
        return df.withColumn("fold", F.pmod(F.xxhash64(F.col(entity)), F.lit(k)).cast("int"))
    ids = distinct_entities(df, entity)
    ranked = ordinal_rank(ids, [], [entity], out="__r")
    folds = ranked.select(entity, F.pmod(F.col("__r"), F.lit(k)).cast("int").alias("fold"))
    return df.join(folds, entity)


def stratified_folds(df: DataFrame, label: str, order: str, k: int = C.CV_FOLDS) -> DataFrame:
    """Within each class, rows in ``order`` are dealt to folds 0..k-1 in
    turn, so every fold holds the class ratio. The per-class position is a
    distributed rank (the two classes do not each go to one task)."""
    r = ordinal_rank(df, [label], [order], out="__r")
    return r.withColumn("fold", F.pmod(F.col("__r"), F.lit(k)).cast("int")).drop("__r")


def cv_summary(fold_auc: DataFrame) -> DataFrame:
    """Mean and population std of the fold AUCs per model."""
    return fold_auc.groupBy("model").agg(F.avg("auroc").alias("cv_auc"),
                                         F.stddev_pop("auroc").alias("cv_std"))
