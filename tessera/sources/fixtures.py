"""Input views derived from the driver's parquet tables.

These only reshape the given tables into the schemas the operators expect
(a sparse panel, a base-prediction table, a prediction log); they do none of
the operators' work. The same definitions exist as SQL text in
``tessera.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is(col: str, v: str):
    return F.col("event_type") == F.lit(v)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> sparse panel: one row per (patient_id, hour), five measures,
    each NULL where the event is of another type, and a 0/1 label."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")

    def meas(kind, base, scale):
        return F.when(_is("event_type", kind), F.lit(base) + v * F.lit(scale))

    return ev.select(
        F.col("user_id").alias("patient_id"),
        (F.row_number().over(w) - 1).cast("int").alias("hour"),
        F.col("event_id"),
        meas("view", 50.0, 0.3).alias("hr"),
        meas("click", 35.5, 0.02).alias("temp"),
        meas("error", 10.0, 0.1).alias("resp"),
        meas("signup", 3.0, 0.05).alias("wbc"),
        meas("purchase", 0.5, 0.01).alias("lactate"),
        F.when(v > F.lit(100.0), 1).otherwise(0).alias("label"),
    )


def panel_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a panel of short histories (for zero padding): of every 45
    events in id order the first is a patient's, the next two another's, and so
    on up to nine."""
    eid = F.col("event_id")
    k = F.floor((F.sqrt(F.pmod(eid, F.lit(45)) * 8 + 1) - 1) / 2).cast("long")
    return panel(spark, sf_dir).withColumns({"patient_id": F.floor(eid / 45).cast("long") * 9 + k, "hour": eid})


def panel_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel in which one patient (-1) holds two thirds of the events; the
    others have no lactate at all, and nobody has a wbc."""
    ev = table(spark, sf_dir, "events")
    v, rest = F.col("value"), F.pmod(F.col("user_id"), F.lit(3)) != 0
    return ev.select(
        F.when(rest, F.lit(-1).cast("long")).otherwise(F.col("user_id").cast("long")).alias("patient_id"),
        F.col("event_id").alias("hour"),
        F.col("event_id"),
        F.when(_is("event_type", "view"), F.lit(50.0) + v * F.lit(0.3)).alias("hr"),
        F.when(_is("event_type", "click"), F.lit(35.5) + v * F.lit(0.02)).alias("temp"),
        F.when(_is("event_type", "error"), F.lit(10.0) + v * F.lit(0.1)).alias("resp"),
        F.lit(None).cast("double").alias("wbc"),
        F.when(_is("event_type", "purchase") & rest, F.lit(0.5) + v * F.lit(0.01)).alias("lactate"),
        F.when(v > F.lit(100.0), 1).otherwise(0).alias("label"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six base-model probabilities and a label per event row."""
    ev = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    y = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return ev.select(
        eid.alias("row_id"),
        y.alias("y"),
        (F.least(F.col("value") / F.lit(200.0), F.lit(1.0)) * F.lit(0.7)
         + F.lit(0.3) * y).alias("m0"),
        (F.pmod(eid, F.lit(101)) / F.lit(100.0)).alias("m1"),
        (F.pmod(eid * 7, F.lit(97)) / F.lit(96.0)).alias("m2"),
        (F.pmod(eid * 13 + uid, F.lit(89)) / F.lit(88.0)).alias("m3"),
        (F.pmod(uid, F.lit(53)) / F.lit(52.0)).alias("m4"),
        (F.pmod(eid * 31, F.lit(1009)) / F.lit(1008.0)).alias("m5"),
    )


def preds_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``preds`` with a missing m0, a NaN m1 and an m2 above 1 in some rows."""
    eid = F.col("row_id")
    return preds(spark, sf_dir).withColumns({
        "m0": F.when(F.pmod(eid, F.lit(17)) != 0, F.col("m0")),
        "m1": F.when(F.pmod(eid, F.lit(19)) == 0, F.lit(float("nan"))).otherwise(F.col("m1")),
        "m2": F.when(F.pmod(eid, F.lit(23)) == 0, F.lit(1.5)).otherwise(F.col("m2"))})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score requests from ``embeddings``: six steps of ten values, some with a
    step too few, a short step, a NaN, an infinite or a missing value."""
    vid = F.col("vec_id")
    every = lambda k: F.pmod(vid, F.lit(k)) == 0
    first = F.col("embedding")[0].cast("double")
    odd = (F.when(every(13), F.lit(float("nan"))).when(every(17), F.lit(float("inf")))
           .when(every(19), F.lit(None).cast("double")).otherwise(first))
    row = lambda k: F.transform(F.slice("embedding", k * 10 + 1, 10), lambda x: x.cast("double"))
    head = F.concat(F.array(odd), F.transform(F.slice("embedding", 2, 9), lambda x: x.cast("double")))
    last = F.when(every(11), F.slice(row(5), 1, 9)).otherwise(row(5))
    whole = F.array(head, *[row(k) for k in range(1, 5)], last)
    return table(spark, sf_dir, "embeddings").select(
        vid.alias("request_id"), F.when(every(7), F.slice(whole, 1, 5)).otherwise(whole).alias("features"))


def predlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log: time stamp, id, prediction, confidence, latency."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("ts"),
        F.col("event_id").alias("id"),
        (F.pmod(F.col("event_id"), F.lit(101)) / F.lit(100.0)).alias("prediction"),
        (F.lit(1.0) - F.pmod(F.col("user_id"), F.lit(53)) / F.lit(104.0)).alias("confidence"),
        F.col("value").alias("processing_time_ms"),
    )


MODEL_COLS = ["m0", "m1", "m2", "m3", "m4", "m5"]
