"""Monitoring of a prediction log.

The log has one row per prediction: ``ts``, ``id``, ``prediction``,
``confidence``, ``processing_time_ms``. The cut-off time is a parameter (not
the wall clock) so results are reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def performance_summary(log: DataFrame, now, days: int = 7) -> DataFrame:
    """L1 + L2: over rows with ts >= now - days: count; mean, population
    std, min, max of prediction and confidence; mean/min/max latency; and
    the risk distribution (>= 0.8 high, >= 0.5 medium, else low)."""
    if isinstance(now, (_dt.datetime, _dt.date)):
        cutoff = F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    else:
        cutoff = F.to_timestamp(F.lit(str(now))) - F.expr(f"INTERVAL {int(days)} DAYS")
    p, c, t = F.col("prediction"), F.col("confidence"), F.col("processing_time_ms")
    recent = log.filter(F.col("ts") >= cutoff)
    return recent.agg(
        F.lit(days).alias("period_days"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(p).alias("prediction_mean"), F.stddev_pop(p).alias("prediction_std"),
        F.min(p).alias("prediction_min"), F.max(p).alias("prediction_max"),
        F.avg(c).alias("confidence_mean"), F.stddev_pop(c).alias("confidence_std"),
        F.min(c).alias("confidence_min"), F.max(c).alias("confidence_max"),
        F.avg(t).alias("mean_processing_time_ms"), F.max(t).alias("max_processing_time_ms"),
        F.min(t).alias("min_processing_time_ms"),
        F.sum((p >= C.RISK_HIGH).cast("long")).alias("risk_high"),
        F.sum(((p >= C.RISK_MEDIUM) & (p < C.RISK_HIGH)).cast("long")).alias("risk_medium"),
        F.sum((p < C.RISK_MEDIUM).cast("long")).alias("risk_low"))


def latest_time(log: DataFrame):
    """The log's last time stamp (one value)."""
    return log.agg(F.max("ts")).first()[0]


def recent_entries(log: DataFrame, cap: int) -> DataFrame:
    """L3: the most recent ``cap`` entries (by ts, then id) - the log's
    retention rule; a top-k, so Spark keeps k rows per task (TakeOrdered)."""
    return log.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(cap)


def window_summary(log: DataFrame, length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Batch twin of the streaming summary (L5): the L1 statistics per
    sliding window."""
    p, c, t = F.col("prediction"), F.col("confidence"), F.col("processing_time_ms")
    g = log.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", length, slide).alias("w"))
    return summary_aggs(g)


def summary_aggs(grouped) -> DataFrame:
    p, c, t = F.col("prediction"), F.col("confidence"), F.col("processing_time_ms")
    return grouped.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(p).alias("prediction_mean"), F.stddev_pop(p).alias("prediction_std"),
        F.min(p).alias("prediction_min"), F.max(p).alias("prediction_max"),
        F.avg(c).alias("confidence_mean"), F.max(t).alias("max_processing_time_ms"),
        F.sum((p >= C.RISK_HIGH).cast("long")).alias("risk_high"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")
