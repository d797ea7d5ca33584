"""Structured Streaming forms of scoring and monitoring.

The reference scores one request at a time, appends it to a JSON log that
keeps the newest entries, and summarises that log. Here rows arrive as a
stream:

* L4: requests are scored by the batch transform (row-wise steps and lookups,
  no state) and written by an idempotent sink: every micro-batch has a folder
  of its own, so a batch that is replayed after a failure replaces itself.
* L5: the summary is a windowed aggregation with a watermark. In append mode a
  window is written once, when the watermark has passed its end, and its state
  is dropped; a row whose windows are all closed is dropped too.
* L3 + A7: the log's retention is keyed state. Each of ``shards`` keys holds
  its newest entries, so no single key takes the whole log, and the newest
  entries of the log are among those of the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..operators import monitor

BATCH = "batch_id"
TS = "ts"


def score_stream(stream: DataFrame, transform) -> DataFrame:
    """L4: apply the batch scoring ``transform`` (DataFrame -> DataFrame)
    to a streaming DataFrame; stateless, so append mode."""
    return transform(stream)


def request_vectors(requests: DataFrame, out: str = "features") -> DataFrame:
    """A3 + D11: requests (patient_id, features[][]) with their time-major vector instead of the window."""
    from pyspark.ml.functions import array_to_vector
    return requests.select("patient_id", array_to_vector(F.flatten("features")).alias(out))


def write_batch(path: str):
    """``foreachBatch`` function: a micro-batch replaces its own folder below ``path``. The batch number is
    part of the folder's name only, so a replay of a batch, whole or cut off, adds nothing."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch}")
    return write


def start_scoring(requests: DataFrame, transform, path: str, checkpoint: str):
    """L4: score a stream of requests into ``path``; runs until what is there has been read."""
    return (score_stream(requests, transform).writeStream.foreachBatch(write_batch(path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_batch`` has written, without the batch number."""
    return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(path)


def summary_stream(log_stream: DataFrame, length: str = "7 days", slide: str = "1 day",
                   watermark: str = "1 day") -> DataFrame:
    """The L1 statistics per sliding window. ``ts`` may be
    TIMESTAMP_NTZ in the source; a watermark needs TIMESTAMP, so it is
    cast first."""
    s = log_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return monitor.summary_aggs(s.groupBy(F.window("ts", length, slide).alias("w")))


def start_closed_windows(summary: DataFrame, path: str, checkpoint: str):
    """Write every window of ``summary_stream`` once, when it is closed; runs until what is there has been read."""
    return (summary.writeStream.foreachBatch(write_batch(path)).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


STATE = "ts array<timestamp>, id array<long>, prediction array<double>, confidence array<double>, processing_time_ms array<double>"
KEPT = "shard int, ts timestamp, id long, prediction double, confidence double, processing_time_ms double"
ENTRY = ["ts", "id", "prediction", "confidence", "processing_time_ms"]


def _newest(cap: int):
    """State function: the ``cap`` newest entries of a shard (by ts, then id), whatever arrives; emits all of them."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(ENTRY, state.get, strict=True))) if state.exists else pd.DataFrame(columns=ENTRY)
        for f in frames:
            f = f[ENTRY]
            both = f if held.empty else pd.concat([held, f], ignore_index=True)
            held = both.sort_values(["ts", "id"], ascending=False, kind="stable").head(cap)
        state.update(tuple(held[c].tolist() for c in ENTRY))
        held = held.assign(shard=key[0])
        yield held[["shard", *ENTRY]]
    return run


def running_log(log_stream: DataFrame, cap: int = C.PREDICTION_LOG_CAP, shards: int = 16) -> DataFrame:
    """L3 + A7: the newest ``cap`` entries of every shard after each micro-batch, as rows of the shards that it touched."""
    typed = log_stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"),
                              *[F.col(c).cast("double").alias(c) for c in ENTRY[2:]])
    return typed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandasWithState(
        _newest(cap), KEPT, STATE, "update", GroupStateTimeout.NoTimeout)


def start_running_log(entries: DataFrame, path: str, checkpoint: str):
    """Keep the log of ``running_log`` in ``path``: a touched shard's newest folder holds its entries; runs until
    what is there has been read."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy("shard").parquet(f"{path.rstrip('/')}/{BATCH}={batch}")
    return (entries.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_running_log(spark: SparkSession, path: str, cap: int = C.PREDICTION_LOG_CAP) -> DataFrame:
    """The newest ``cap`` entries: of every shard its last batch, of those the newest by ts, then id."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("shard").agg(F.max(BATCH).alias(BATCH))
    return monitor.recent_entries(rows.join(last, ["shard", BATCH]).drop("shard", BATCH), cap)


def start(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Start a query into a memory table (tests) with a checkpoint folder
    under the session's shared checkpoint directory."""
    return (df.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
