"""Data-quality checks.

Findings are rows ``(check, column, value, severity, passed)`` so a whole
validation is one small table; every statistic comes from one aggregate pass
(partial aggregation, no row reaches the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import PanelSpec, present
from .ordering import unpivot

FINDING_SCHEMA = "check string, column_name string, value double, severity string, passed boolean"


def required_columns(df: DataFrame, required=("patient_id", "hour")) -> list:
    """(column, present?) for each required column."""
    have = {c.lower() for c in df.columns}
    return [(c, c.lower() in have) for c in required]


def key_types(df: DataFrame, keys=("patient_id", "hour")) -> list:
    """(column, numeric?) for each key column that exists."""
    out = []
    for c in present(df.columns, list(keys)):
        out.append((c, isinstance(df.schema[c].dataType, NumericType)))
    return out


def _missing(df: DataFrame, c: str) -> F.Column:
    """NULL, or NaN in a floating column."""
    m = F.col(c).isNull()
    return m | F.isnan(F.col(c)) if df.schema[c].dataType.typeName() in ("double", "float") else m


def null_percent(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Percent NULL (or NaN) per column and whether it exceeds 50 %."""
    one = df.agg(*[(F.avg(_missing(df, c).cast("double")) * F.lit(100.0)).alias(c) for c in df.columns])
    lg = unpivot(one, [], df.columns, "column_name", "null_percent")
    return lg.withColumn("high_missing", F.col("null_percent") > F.lit(threshold))


def profile(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Rows, columns, distinct entities, first/last time, and the
    summary (mean, min, max) of the per-column NULL percents."""
    ent = present(df.columns, [spec.entity])
    tim = present(df.columns, [spec.time])
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    aggs.append(F.countDistinct(ent[0]).alias("unique_entities") if ent else F.lit(0).alias("unique_entities"))
    aggs.append(F.min(tim[0]).cast("double").alias("min_time") if tim else F.lit(None).cast("double").alias("min_time"))
    aggs.append(F.max(tim[0]).cast("double").alias("max_time") if tim else F.lit(None).cast("double").alias("max_time"))
    one = df.agg(*aggs, *[(F.avg(_missing(df, c).cast("double")) * F.lit(100.0)).alias(f"__np{i}") for i, c in enumerate(df.columns)])
    percents = F.array(*[F.col(f"__np{i}") for i in range(len(df.columns))])
    total = F.aggregate(percents, F.lit(0.0), lambda acc, x: acc + x)
    return one.select("total_rows", "unique_entities", "min_time", "max_time", F.lit(len(df.columns)).alias("total_columns"),
                      (total / F.lit(float(len(df.columns)))).alias("null_pct_mean"),
                      F.array_min(percents).alias("null_pct_min"), F.array_max(percents).alias("null_pct_max"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def class_imbalance(df: DataFrame, label: str = "label", severe: float = 0.1) -> DataFrame:
    """min/max class count ratio; flagged severe below 0.1; defined only
    when the label has exactly two values."""
    d = label_distribution(df, label)
    return d.agg(F.count(F.lit(1)).alias("classes"), F.min("count").alias("min_count"),
                 F.max("count").alias("max_count")).select(
        "classes", "min_count", "max_count",
        F.when(F.col("classes") == 2, F.col("min_count") / F.col("max_count")).alias("imbalance_ratio"),
        F.when(F.col("classes") == 2, F.col("min_count") / F.col("max_count") < F.lit(severe))
         .otherwise(F.lit(False)).alias("severe"))


def input_checks(df: DataFrame, features: str = "features", steps: int | None = 6,
                 width: int | None = None) -> DataFrame:
    """J7-J9 per request row: shape (steps, widths), NULL, NaN and
    infinity flags, and min/max/mean/population std of the present values."""
    a = F.col(features)
    # the present values and their mean are columns of their own, so that each is taken once a row
    df = df.withColumn("__raw", F.flatten(a)).withColumn("__flat", F.filter("__raw", lambda x: x.isNotNull()))
    raw, flat = F.col("__raw"), F.col("__flat")
    n = F.size(flat).cast("double")
    df = df.withColumn("__mean", F.aggregate(flat, F.lit(0.0), lambda acc, x: acc + x) / n)
    has_null, mean = F.exists(raw, lambda x: x.isNull()), F.col("__mean")
    var = F.aggregate(flat, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n
    w = width
    bad_width = F.exists(a, lambda r: F.size(r) != F.size(F.element_at(a, 1))) if w is None else \
        F.exists(a, lambda r: F.size(r) != F.lit(w))
    shape_ok = ~bad_width
    if steps is not None:
        shape_ok = shape_ok & (F.size(a) == F.lit(steps))
    has_nan = F.exists(flat, lambda x: F.isnan(x))
    has_nan = F.coalesce(has_nan, F.lit(False))
    has_inf = F.exists(flat, lambda x: F.abs(x) == F.lit(float("inf")))
    return df.select(
        "*", F.size(a).alias("n_steps"), F.size(F.element_at(a, 1)).alias("n_features"),
        shape_ok.alias("shape_ok"), has_null.alias("has_null"), has_nan.alias("has_nan"),
        has_inf.alias("has_inf"),
        F.array_min(flat).alias("value_min"), F.array_max(flat).alias("value_max"),
        mean.alias("value_mean"), F.sqrt(var).alias("value_std"),
        (shape_ok & ~has_null & ~has_nan & ~has_inf).alias("is_valid")).drop("__raw", "__flat", "__mean")


def validation_report(df: DataFrame, spec: PanelSpec = PanelSpec(), required=None) -> DataFrame:
    """All panel checks as one findings table; the report is valid when
    no finding of severity 'error' failed."""
    spark = df.sparkSession
    required = required or (spec.entity, spec.time)
    rows = [("required_column", c, None, "error", ok) for c, ok in required_columns(df, required)]
    rows += [("numeric_key", c, None, "warning", ok) for c, ok in key_types(df, required)]
    fixed = spark.createDataFrame(rows, FINDING_SCHEMA)
    nulls = null_percent(df).select(F.lit("null_percent").alias("check"), "column_name",
                                    F.col("null_percent").alias("value"), F.lit("warning").alias("severity"),
                                    (~F.col("high_missing")).alias("passed"))
    out = fixed.unionByName(nulls)
    lab = present(df.columns, [spec.label]) if spec.label else []
    if lab:
        imb = class_imbalance(df, lab[0]).select(
            F.lit("class_imbalance").alias("check"), F.lit(lab[0]).alias("column_name"),
            F.col("imbalance_ratio").alias("value"), F.lit("warning").alias("severity"),
            (~F.col("severe")).alias("passed"))
        out = out.unionByName(imb)
    return out
