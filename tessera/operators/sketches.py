"""Mergeable sketches of a growing table (sketch option of SURVEY C3, D12, J4).

Exact medians and distinct counts read the whole table again whenever rows
arrive. Here every part of the table (a day, a load) is read once: per part
and feature a quantile sketch (KLL, over doubles) and a distinct-count sketch
(HLL) are stored, a few kilobytes each, and any later answer merges stored
sketches without rereading rows. The rank error of a KLL sketch with parameter
k is about 1.65 % for k = 200 and falls with 1/k; that of an HLL count with
2^12 registers about 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import unpivot

KLL_K = 800  # rank error about 0.45 %
HLL_BITS = 12


def part_sketches(df: DataFrame, part: str, features: list, k: int = KLL_K) -> DataFrame:
    """(part, feature, n, quantiles, distincts): one row per part and feature, over its non-NULL values."""
    long = unpivot(df.select(F.col(part).alias("part"), *[F.col(c).cast("double").alias(c) for c in features]), ["part"], features, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("part", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", k).alias("quantiles"),
        F.hll_sketch_agg(F.col("value").cast("string"), HLL_BITS).alias("distincts"))


def merged(sketches: DataFrame) -> DataFrame:
    """One row per feature: the sketches of all given parts merged (``F.col('part')`` filters before are cheap)."""
    return sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
                                           F.hll_union_agg("distincts").alias("distincts"))


def sketch_quantiles(merged_rows: DataFrame, probs: list) -> DataFrame:
    """(feature, n, prob, value): approximate quantiles."""
    at = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))).alias("value")) for p in probs])
    return merged_rows.select("feature", "n", F.explode(at).alias("q")).select("feature", "n", "q.prob", "q.value")


def sketch_medians(merged_rows: DataFrame) -> dict:
    """{feature: approximate median}, as ``median_fill`` takes them."""
    return {r["feature"]: r["value"] for r in sketch_quantiles(merged_rows, [0.5]).collect()}  # one row per feature


def sketch_scaler(merged_rows: DataFrame) -> DataFrame:
    """Approximate centers and scales, in the form of ``robust_scaler_fit``."""
    q = sketch_quantiles(merged_rows, [0.25, 0.5, 0.75]).groupBy("feature").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    iqr = F.col("`0.75`") - F.col("`0.25`")
    return q.select("feature", F.col("`0.5`").alias("center"), F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def sketch_distincts(merged_rows: DataFrame) -> DataFrame:
    """(feature, n, distinct): approximate distinct counts."""
    return merged_rows.select("feature", "n", F.hll_sketch_estimate("distincts").alias("distinct"))
