"""Sources and sinks.

Readers take explicit schemas (no inference on big inputs); writers go to
parquet/CSV/JSON folders that Spark writes in parallel, one file per task.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..operators import clean

REQUEST_SCHEMA = StructType([
    StructField("patient_id", StringType(), True),
    StructField("features", ArrayType(ArrayType(DoubleType())), True),
])


def read_panel_csv(spark: SparkSession, path: str, schema=None, nrows: int | None = None,
                   order: list | None = None) -> DataFrame:
    """A1 + B1 + B2: header CSV with a given schema (or inference when none
    is given), index column dropped, flags to TINYINT, NaN -> NULL. A row
    cap keeps the first ``nrows`` rows in ``order`` (CSV files have no
    reliable order across tasks)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = clean.downcast(clean.drop_index_columns(r.csv(path)))
    if nrows is not None:
        df = df.orderBy(*(order or df.columns[:2])).limit(nrows)
    return df


def read_batch_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A2: batch-scoring CSV; rows that fail to parse are kept with their
    text in ``_corrupt_record`` instead of failing the job."""
    full = StructType(schema.fields + [StructField("_corrupt_record", StringType(), True)])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").schema(full).csv(path))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON-lines score requests (patient_id, features[][])."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def parse_requests(df: DataFrame, col: str = "value") -> DataFrame:
    """A3: requests held as JSON strings -> typed columns."""
    return df.select(F.from_json(F.col(col), REQUEST_SCHEMA).alias("r")).select("r.*")


def write_base_predictions(oof: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: per-model prediction sink, one folder per model, stamped."""
    (oof.withColumn("saved_at", F.current_timestamp())
     .write.mode(mode).partitionBy("model").parquet(path))


def write_meta_dataset(meta: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A5: the meta dataset (CSV with header, or parquet)."""
    w = meta.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_metadata(spark: SparkSession, meta_columns: list, base_models: list,
                   target: DataFrame, path: str) -> None:
    """Metadata JSON - base models, meta-feature names, class balance
    (from G14's one-row table) and a creation time."""
    t = target.first()
    row = [(base_models, meta_columns, int(t["positive_class"]), int(t["negative_class"]),
            float(t["class_ratio"]), _dt.datetime.now().isoformat())]
    (spark.createDataFrame(row, "base_models array<string>, meta_features array<string>, "
                                "positive_class long, negative_class long, class_ratio double, created_at string")
     .coalesce(1).write.mode("overwrite").json(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Read the metadata back."""
    return spark.read.json(path)


def append_prediction_log(entries: DataFrame, path: str) -> None:
    """Append log rows; ``processing_time`` seconds are stored as
    ``processing_time_ms``."""
    out = entries
    if "processing_time" in entries.columns:
        out = entries.withColumn("processing_time_ms", F.col("processing_time") * 1000.0).drop("processing_time")
    out.write.mode("append").parquet(path)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_models(fitted: dict, path: str) -> None:
    """All that scoring needs: every fitted model (as a one-stage ML pipeline, which knows its
    own class), the fitted panel transformer if there is one, the training distribution of scores
    with its sorted lookup table, the model names in order and the feature count."""
    from pyspark.ml import PipelineModel
    for name, m in fitted["models"].items():
        PipelineModel([m]).write().overwrite().save(f"{path}/base/{name}")
    PipelineModel([fitted["meta_model"]]).write().overwrite().save(f"{path}/meta")
    if fitted.get("panel") is not None:
        fitted["panel"].write().overwrite().save(f"{path}/panel")
    counts, ranks = fitted["ecdf"], fitted["ranks"]
    counts.write.mode("overwrite").parquet(f"{path}/score_counts")
    ranks["table"].write.mode("overwrite").parquet(f"{path}/ranks")
    counts.sparkSession.createDataFrame(
        [(fitted["names"], fitted["n_features"], [[float(x) for x in ranks["splits"][n]] for n in fitted["names"]], ranks["rows"],
          fitted.get("panel") is not None)],
        "names array<string>, n_features int, splits array<array<double>>, rank_rows long, has_panel boolean") \
        .write.mode("overwrite").parquet(f"{path}/info")


def load_models(spark: SparkSession, path: str) -> dict:
    """Load what ``save_models`` wrote; a part that cannot be read raises."""
    from pyspark.ml import PipelineModel

    from ..operators.panel_model import PanelPreprocessorModel
    info = spark.read.parquet(f"{path}/info").first()
    names = list(info["names"])
    return {"models": {n: PipelineModel.load(f"{path}/base/{n}").stages[0] for n in names},
            "meta_model": PipelineModel.load(f"{path}/meta").stages[0], "names": names, "n_features": info["n_features"],
            "panel": PanelPreprocessorModel.load(f"{path}/panel") if info["has_panel"] else None,
            "ecdf": spark.read.parquet(f"{path}/score_counts"),
            "ranks": {"splits": dict(zip(names, info["splits"], strict=True)), "table": spark.read.parquet(f"{path}/ranks"),
                      "rows": info["rank_rows"]}}


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per saved model: position, name, kind, feature count and the ensemble's models."""
    saved = load_models(spark, path)
    rows = [(i, n, type(saved["models"][n]).__name__.removesuffix("Model"), saved["n_features"], len(saved["names"]))
            for i, n in enumerate(saved["names"])]
    rows.append((len(rows), "ensemble", type(saved["meta_model"]).__name__.removesuffix("Model"), saved["n_features"], len(saved["names"])))
    return spark.createDataFrame(rows, "position int, name string, kind string, n_features int, n_base_models int")


MANIFEST_SCHEMA = "name string, version long, path string, parts array<string>, published_at timestamp"


def publish_models(fitted: dict, root: str, name: str = "ensemble") -> int:
    """A8 + A9: save an ensemble as the next version below ``root`` and return its number.

    Parts go to a folder of their own first; the manifest row, whose file appears at once when
    its write commits, comes last. A reader therefore sees the version before or the whole new
    one, never a part of it, and a publisher that dies in between leaves only an unnamed folder."""
    spark = fitted["ecdf"].sparkSession
    version = max((r["version"] for r in published_versions(spark, root, name).select("version").collect()), default=0) + 1
    path = f"{root.rstrip('/')}/{name}-{version}-{uuid.uuid4().hex}"
    save_models(fitted, path)
    parts = [f"base/{n}" for n in fitted["names"]] + ["meta", "score_counts", "ranks", "info"] + ["panel"] * (fitted.get("panel") is not None)
    row = [(name, version, path, parts, _dt.datetime.now())]
    spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return version


def published_versions(spark: SparkSession, root: str, name: str = "ensemble") -> DataFrame:
    """The manifest rows of ``name``; none before the first publication."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        rows = spark.createDataFrame([], MANIFEST_SCHEMA)
    return rows.where(F.col("name") == name)


def load_published(spark: SparkSession, root: str, name: str = "ensemble", version: int | None = None) -> dict:
    """The given or the latest published version; of two publishers that took one number, the later."""
    rows = published_versions(spark, root, name)
    rows = rows if version is None else rows.where(F.col("version") == version)
    last = rows.orderBy(F.desc("version"), F.desc("published_at")).first()
    if last is None:
        raise FileNotFoundError(f"no published version of {name} below {root}")
    return {**load_models(spark, last["path"]), "version": last["version"]}


REGISTRY_SCHEMA = "model_name string, version string, path string, metrics map<string,double>, registered_at timestamp"


def register_model(spark: SparkSession, registry: str, name: str, version: str, path: str,
                   metrics: dict) -> None:
    """Append one registry entry (append-only table)."""
    row = [(name, version, path, {k: float(v) for k, v in metrics.items()}, _dt.datetime.now())]
    spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(registry)


def latest_models(spark: SparkSession, registry: str) -> DataFrame:
    """The latest entry per model (list/get)."""
    r = spark.read.parquet(registry)
    w = Window.partitionBy("model_name").orderBy(F.col("registered_at").desc(), F.col("version").desc())
    return r.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def write_reports(tables: dict, path: str) -> list:
    """A10: write every report table as parquet; returns the names written."""
    done = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        done.append(name)
    return done


def write_reports_apart(tables: dict, path: str, parallel: int = 4) -> list:
    """A10 + I25: every table (a DataFrame, or a function that makes one) written by a job of its own,
    at most ``parallel`` at once. A table that fails is listed and leaves the others alone; its folder
    holds no committed file. Returns (name, ok, rows, error) per table, in the given order; ``rows``
    is counted in what was written (from the files' footers). An ``Observation`` would count on the
    way, but a session that has used one cannot be serialized, and a forest's training summary holds
    the session: the forest would no longer score."""
    from ..operators.learners import run_bounded
    spark = SparkSession.getActiveSession()

    def job(name: str, table):
        def run():
            try:
                df = table() if callable(table) else table
                df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
                return name, True, spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/{name}").count(), None
            except Exception as e:  # noqa: BLE001 - whatever a table fails of is its status
                return name, False, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        return run
    return run_bounded([job(n, t) for n, t in tables.items()], parallel)


def write_status(spark: SparkSession, status: list, path: str) -> DataFrame:
    """The rows of ``write_reports_apart`` as a table, written beside the reports."""
    df = spark.createDataFrame(status, "name string, ok boolean, rows long, error string")
    df.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/status")
    return spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/status")


def check_training_upload(path: str) -> None:
    """A training job accepts CSV inputs only."""
    if not str(path).lower().endswith(".csv"):
        raise ValueError("Only CSV files are supported")
