"""Mixing sources to target weights by hash-threshold histograms.

Each source's budget of words is met without sorting: a document's hash (md5
of its id and text) gives a fixed place in [0, 2^36). Words are summed per source and
hash bucket; the bucket in which the running sum crosses the budget is the
boundary; only its rows are summed again by finer buckets (three rounds of
4,096). A document is then taken if its hash lies below its source's
threshold: a filter. A target above the source's size first takes every
document once and meets the rest with the threshold, so budgets are nested:
a smaller target's choice is contained in a larger one's.

Scale: one pre-aggregated shuffle of at most 4,096 rows per source and task
for each round; a source that holds most rows is many (source, bucket) groups.
Per-source figures (one row per source) are joined as a table; Spark
broadcasts it only if it measures it as small, and the join is salted by
bucket otherwise (``SALT``), so that a hot source is split. The three rounds
read one stored slim table (source, hash, size), not the texts. No Python
touches the rows.

Cases: NULL text has size 0; a NULL source is a source of its own, last in
order; rows that share an id, or have none, are told apart by their text;
repeated rows have equal hashes and are taken together; sources without words get target 0; equal hashes in
the last boundary bucket are taken together if that comes nearer to the
budget. An empty table gives no rows. Only doc_id, text, source
and the columns named in ``carry`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored

LEVEL_BITS = 12
LEVELS = 3
SALT = 32


def _hash36(doc_id: Column, text: Column) -> Column:
    """First nine hex digits of md5("doc_id:text") as a number: rows that share an id, or have none, are told apart by their text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(both.cast("binary")), 1, 9)
    return F.conv(digits, 16, 10).cast("long")


def _shift(level: int) -> int:
    return LEVEL_BITS * (LEVELS - 1 - level)


def targets(sizes: DataFrame, weights: list[int], share: float, limit: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Water filling: sources sorted by size / weight; those at the front hit
    ``limit`` times their size, the others share what is left by weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("k", F.row_number().over(by_name) - 1) \
        .withColumn("weight", F.element_at(cycle, (F.col("k") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size_before = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_before = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(every).cast("double")
    w = (w.withColumn("left_words", F.lit(share) * total - F.lit(limit) * size_before.cast("double"))
         .withColumn("left_weight", F.sum("weight").over(every) - weight_before)
         .withColumn("part", F.col("left_words") * F.col("weight") / F.col("left_weight"))
         .withColumn("top", F.lit(limit) * F.col("source_size").cast("double"))
         # the first source in this order whose part fits fixes the level for itself and all after it
         .withColumn("fits", F.min(F.when(F.col("part") <= F.col("top"), F.struct(
             F.row_number().over(order).alias("at"), F.col("left_words"), F.col("left_weight")))).over(every)))
    level = F.col("fits.left_words") * F.col("weight") / F.col("fits.left_weight")
    return w.select("source", "source_size", F.when(
        F.row_number().over(order) >= F.col("fits.at"), level).otherwise(F.col("top")).alias("target"))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, limit: int = 2,
        carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), repeats, and the columns of ``carry``."""
    carry = carry or []
    h = _hash36(F.col("doc_id"), F.col("text"))
    slim = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), h.alias("h"), *carry), "mix-slim")
    keyed = slim.withColumn("salt", (F.col("h") % SALT).cast("int"))
    source_sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    # whole copies of a source, then the words that the threshold has to give
    goal = targets(source_sizes, list(weights), share, float(limit)) \
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("whole", F.least(F.col("whole"), F.lit(limit)).cast("long")) \
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # cut: hashes below it are taken; prefix: the boundary bucket that is still to be split
    state = goal.select("source", "source_size", "target", "whole", "need",
                        F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(LEVELS):
        s = _shift(level)
        at = keyed.join(_salted(state.select(F.col("source").alias("src"), "prefix")),
                        F.col("source").eqNullSafe(F.col("src")) & (F.col("salt") == F.col("s")))
        inside = at.where(F.shiftright("h", s + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", s).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("lower", F.coalesce(F.sum("words").over(run), F.lit(0)))
        found = (sums.withColumnRenamed("source", "src").join(
            state.select("source", "need", "below"), F.col("source").eqNullSafe(F.col("src")))
            .withColumn("from", F.col("below") + F.col("lower"))
            # the boundary: the last bucket that starts at or below the need
            .where(F.col("from") <= F.col("need"))
            .groupBy("src").agg(F.max(F.struct("bucket", "from", "words")).alias("m")))
        state = stored(state.join(found, F.col("source").eqNullSafe(F.col("src")), "left")
                       .select("source", "source_size", "target", "whole", "need",
                               F.coalesce("m.bucket", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
                               F.coalesce("m.from", "below").alias("below"),
                               F.coalesce("m.words", F.lit(0)).alias("words")), f"mix-level{level}") \
            .withColumn("cut", F.when(F.col("need") - F.col("below") >= F.col("below") + F.col("words") - F.col("need"),
                                      F.col("prefix") + 1).otherwise(F.col("prefix")))
    chosen = _salted(state.select(F.col("source").alias("src"), "source_size", "target", "whole", "cut"))
    out = keyed.join(chosen, F.col("source").eqNullSafe(F.col("src")) & (F.col("salt") == F.col("s")))
    repeats = F.least(F.col("whole") + (F.col("h") < F.col("cut")).cast("long"), F.lit(limit).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"),
                      repeats.alias("repeats"), *carry)


def _salted(per_source: DataFrame) -> DataFrame:
    """Each source's row once per salt, so that a join on (source, salt) splits a hot source."""
    return per_source.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 3, 1, 2, 150 %, at most twice."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
