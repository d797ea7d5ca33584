import os

from pyspark.sql import functions as F

from conftest import SF

import __spark_entry__ as E

ROWS_ONLY = {"validation_report", "holdout_split", "oof_predictions", "top_importances"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"patient_id", "step", "is_pad"} <= set(df.columns)


def test_every_query_has_sql_or_is_rows_only():
    q, s = ({k: v for k, v in x.items() if k not in E.LLM_QUERIES} for x in (E.queries(), E.oracle_sql()))
    assert set(q) - set(s) <= ROWS_ONLY
    assert set(s) <= set(q)


def test_stream_summary_equals_batch(spark, scratch):
    from tessera.operators import monitor
    from tessera.sources import fixtures as fx
    from tessera.streaming import monitor_stream
    log = fx.predlog(spark, SF)
    src = os.path.join(scratch, "log")
    log.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = monitor_stream.start(monitor_stream.summary_stream(stream), "summary_t", "complete",
                             os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("summary_t").collect())
    ref = sorted(tuple(r) for r in monitor.window_summary(log).collect())
    assert len(got) == len(ref)
    assert [r[:3] for r in got] == [r[:3] for r in ref]


def test_stream_scoring_equals_batch(spark, scratch):
    from tessera.operators import clean
    from tessera.sources import fixtures as fx
    from tessera.streaming import monitor_stream
    log = fx.predlog(spark, SF)
    src = os.path.join(scratch, "log2")
    log.write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    tr = (lambda d: clean.risk_levels(d, "prediction").select("id", "risk_level"))
    q = monitor_stream.start(monitor_stream.score_stream(stream, tr), "scores_t", "append",
                             os.path.join(scratch, "ck2"))
    q.awaitTermination()
    assert sorted(spark.table("scores_t").collect()) == sorted(tr(log).collect())


def test_sources_roundtrip(spark, scratch):
    from tessera.sources import fixtures as fx
    from tessera.sources import io
    p = fx.panel(spark, SF)
    path = os.path.join(scratch, "panel_csv")
    p.write.option("header", True).csv(path)
    back = io.read_panel_csv(spark, path, schema=p.schema)
    assert back.count() == p.count()
    io.register_model(spark, os.path.join(scratch, "reg"), "ens", "1", "/x", {"auc": 0.7})
    io.register_model(spark, os.path.join(scratch, "reg"), "ens", "2", "/y", {"auc": 0.8})
    latest = io.latest_models(spark, os.path.join(scratch, "reg")).collect()
    assert len(latest) == 1 and latest[0].version == "2"
