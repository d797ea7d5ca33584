"""Streams against batches: scoring with a saved model, late rows, the running log."""
import datetime as dt
import os

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import learners, monitor
from tessera.plans import pipeline
from tessera.sources import fixtures as fx
from tessera.sources import io
from tessera.streaming import monitor_stream as ms


def rows(df):
    return sorted(map(str, df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"}).collect()))


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_scoring_with_a_published_model(spark, scratch):
    req = fx.table(spark, SF, "embeddings").where("vec_id % 2 = 1")
    grid = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(F.slice("embedding", k * 10 + 1, F.lit(10)), lambda x: x.cast("double")))
    req.select(F.col("vec_id").cast("string").alias("patient_id"), grid.alias("features")).repartition(3).write.json(f"{scratch}/requests")
    known = fx.table(spark, SF, "embeddings").select(F.col("vec_id").cast("string").alias("patient_id"), grid.alias("features"), "label")
    train = ms.request_vectors(known).join(known.select("patient_id", (F.col("label") < 5).cast("int").alias("label")), "patient_id") \
        .withColumnRenamed("patient_id", "row_id")
    ests = {f"m{i}": LogisticRegression(maxIter=3, regParam=0.1 * (i + 1), featuresCol="features", labelCol="label", weightCol="weight") for i in range(6)}
    fitted = pipeline.train_stacked(train, learners=ests, scale=0.01)
    assert io.publish_models(fitted, f"{scratch}/models") == 1
    saved = io.load_published(spark, f"{scratch}/models")
    score = lambda d: pipeline.score_stacked(saved, ms.request_vectors(d), row_id="patient_id")
    batch = score(io.read_requests(spark, f"{scratch}/requests"))
    stream = spark.readStream.schema(io.REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{scratch}/requests")
    ms.start_scoring(stream, score, f"{scratch}/out", f"{scratch}/ck").awaitTermination()
    read = lambda: rows(ms.read_batches(spark, f"{scratch}/out", batch.schema))
    assert read() == rows(batch) and len(read()) == req.count()
    # the last batch was written but its commit was lost: it is read and written again
    commits = sorted(f for f in os.listdir(f"{scratch}/ck/commits") if f.isdigit())
    assert len(commits) == 3
    os.remove(f"{scratch}/ck/commits/{commits[-1]}")
    crc = f"{scratch}/ck/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    ms.start_scoring(stream, score, f"{scratch}/out", f"{scratch}/ck").awaitTermination()
    assert os.path.exists(f"{scratch}/ck/commits/{commits[-1]}") and read() == rows(batch)


def test_a_crash_between_parts_leaves_the_old_version(spark, scratch, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    df = fx.table(spark, SF, "embeddings").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))).alias("features"),
        (F.col("label") < 5).cast("int").alias("label"))
    ests = {f"m{i}": LogisticRegression(maxIter=2, featuresCol="features", labelCol="label", weightCol="weight") for i in range(6)}
    fitted = pipeline.train_stacked(df, learners=ests, scale=0.01)
    root = f"{scratch}/models"
    assert io.published_versions(spark, root).collect() == []
    assert io.publish_models(fitted, root) == 1
    whole = io.save_models

    def dies(f, path):
        whole({**f, "names": f["names"][:3], "ranks": {**f["ranks"]}}, path)
        raise OSError("lost")
    monkeypatch.setattr(io, "save_models", dies)
    try:
        io.publish_models(fitted, root)
        raise AssertionError("not reached")
    except OSError:
        pass
    assert io.load_published(spark, root)["version"] == 1 and len(io.load_published(spark, root)["names"]) == 6
    monkeypatch.undo()
    assert io.publish_models(fitted, root) == 2 and io.load_published(spark, root)["version"] == 2
    assert io.load_published(spark, root, version=1)["version"] == 1


def test_late_rows_are_dropped_and_closed_windows_equal_batch(spark, scratch):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    entry = lambda t, i: (t, i, i / 100.0, 0.5, float(i))
    schema = "ts timestamp, id long, prediction double, confidence double, processing_time_ms double"
    first = [entry(day(1, h), h) for h in range(0, 24, 3)]
    second = [entry(day(9, 12), 30), entry(day(10), 31), entry(day(1, 5), 90)]  # the last is late only after this batch
    third = [entry(day(1, 7), 91), entry(day(9, 13), 32), entry(day(30), 33)]  # 91 is late: all its windows are closed
    src = f"{scratch}/log"
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ms.summary_stream(stream_of(spark, src, schema), "1 day", "1 day", "2 days")
        ms.start_closed_windows(stream, f"{scratch}/out", f"{scratch}/ck").awaitTermination()
    on_time = spark.createDataFrame([r for r in first + second + third if r[1] != 91], schema)
    closed = monitor.window_summary(on_time, "1 day", "1 day").where(F.col("window_end") <= F.lit(day(28)))
    got = ms.read_batches(spark, f"{scratch}/out", closed.schema)
    assert rows(got) == rows(closed) and got.count() == 3
    assert got.where(F.col("window_start") == F.lit(day(1))).first()["total_predictions"] == 9


def test_running_log_equals_the_batch_cut_after_every_batch(spark, scratch):
    log = fx.predlog(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    src, seen = f"{scratch}/log", None
    for k in range(3):
        part = log.where(F.pmod("id", F.lit(3)) == k)
        part.coalesce(1).write.mode("append").parquet(src)
        seen = part if seen is None else seen.unionByName(part)
        entries = ms.running_log(stream_of(spark, src, log.schema), cap=37, shards=4)
        ms.start_running_log(entries, f"{scratch}/out", f"{scratch}/ck").awaitTermination()
        assert rows(ms.read_running_log(spark, f"{scratch}/out", 37).select(*log.columns)) == rows(monitor.recent_entries(seen, 37))


def test_positive_probability_of_a_broken_score(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType
    df = spark.createDataFrame([(Vectors.dense([0.3, 0.7]),), (Vectors.dense([float("nan"), float("nan")]),)],
                               StructType([StructField("probability", VectorUDT())]))
    assert [r.p for r in learners.positive_probability(df).collect()] == [0.7, 0.5]
