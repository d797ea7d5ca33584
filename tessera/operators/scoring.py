"""Scoring and explanation of windows.

Base-model predictions are kept as columns, so one pass yields the ensemble
probability, the risk level, the confidence and the explanation - the
reference runs its base models twice per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X


def confidence(pred_cols: list) -> F.Column:
    """K2: max(0, 1 - population std of the base predictions); 0.8 when
    there is a single model."""
    if len(pred_cols) <= 1:
        return F.lit(0.8)
    return F.greatest(F.lit(0.0), F.lit(1.0) - X.row_std(pred_cols))


def explanation(pred_cols: list, names: list | None = None) -> F.Column:
    """K3: struct(base_predictions map, ensemble_mean, prediction_std,
    model_count)."""
    names = names or [f"model_{i}" for i in range(len(pred_cols))]
    return F.struct(
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(c) for c in pred_cols]))
        .alias("base_predictions"),
        X.row_mean(pred_cols).alias("ensemble_mean"),
        X.row_std(pred_cols).alias("prediction_std"),
        F.lit(len(pred_cols)).alias("model_count"))


def score_summary(df: DataFrame, pred_cols: list, prob: str, keys: list) -> DataFrame:
    """K1 (given the ensemble probability ``prob``): risk level, confidence
    and explanation per row; failing base predictions count as 0.5 (K12)."""
    filled = df.withColumns({c: X.invalid_to(c) for c in pred_cols})
    return filled.select(*keys, F.col(prob).alias("probability"), X.risk_level(prob).alias("risk_level"),
                         confidence(pred_cols).alias("confidence"), explanation(pred_cols).alias("explanation"))


def contributions(df: DataFrame, pred_cols: list, keys: list, names: list | None = None) -> DataFrame:
    """K7 + K8 long: per row and model, prediction, contribution
    (prediction - row mean) and relative importance |c| / (std + 1e-6)."""
    names = names or pred_cols
    filled = df.select(*keys, *[X.invalid_to(c).alias(n) for c, n in zip(pred_cols, names)])
    mean = X.row_mean(names)
    std = X.row_std(names, mean)
    base = filled.select("*", mean.alias("__mean"), std.alias("__std"))
    lg = base.unpivot([*keys, "__mean", "__std"], names, "model", "prediction")
    return lg.select(*keys, "model", "prediction",
                     (F.col("prediction") - F.col("__mean")).alias("contribution"),
                     (F.abs(F.col("prediction") - F.col("__mean")) / (F.col("__std") + F.lit(1e-6)))
                     .alias("relative_importance"))


def explain_summary(df: DataFrame, pred_cols: list, keys: list, names: list | None = None) -> DataFrame:
    """K9 + K10 per row: mean, std, most influential model (largest
    |contribution|, the first model wins ties) and agreement level."""
    names = names or pred_cols
    filled = df.select(*keys, *[X.invalid_to(c).alias(n) for c, n in zip(pred_cols, names)])
    mean = X.row_mean(names)
    std = X.row_std(names, mean)
    absdev = F.array(*[F.abs(F.col(n) - mean) for n in names])
    top = F.array_max(absdev)
    # first position holding the maximum
    pos = F.array_position(absdev, top)
    most = F.element_at(F.array(*[F.lit(n) for n in names]), pos.cast("int"))
    return filled.select(*keys, mean.alias("mean_prediction"), std.alias("std_prediction"),
                         most.alias("most_influential"), X.agreement_level(std).alias("agreement_level"))


def reshape_flat(df: DataFrame, values: str, steps: int = C.TIME_WINDOW, out: str = "window") -> DataFrame:
    """K4: a flat row of n numbers -> ``steps`` x ceil(n/steps) window,
    time-major, zero-padded at the end (the reference's padding rule fails
    for most n; this pads to a multiple of ``steps``)."""
    v = F.col(values)
    n = F.size(v)
    f = F.ceil(n / F.lit(float(steps))).cast("int")
    padded = F.concat(v, F.array_repeat(F.lit(0.0), f * F.lit(steps) - n))
    win = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(padded, i * f + 1, f))
    return df.withColumn(out, F.when(n > 0, win)).withColumn("features_per_step", f)


def batch_rows(df: DataFrame, idx: str, id_col: str | None, prob: str) -> DataFrame:
    """K5: row index, patient id (``patient_{idx}`` when missing),
    probability and risk level."""
    pid = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("patient_"), F.col(idx).cast("string"))) \
        if id_col else F.concat(F.lit("patient_"), F.col(idx).cast("string"))
    return df.select(F.col(idx).alias("row_index"), pid.alias("patient_id"),
                     F.col(prob).alias("probability"), X.risk_level(prob).alias("risk_level"))


def route_errors(df: DataFrame, valid: str, idx: str, show: int = 10):
    """K6: (good rows, bad rows, totals, first ``show`` bad rows by index)."""
    good = df.filter(F.col(valid))
    bad = df.filter(~F.col(valid))
    totals = df.agg(F.sum(F.col(valid).cast("long")).alias("total_processed"),
                    F.sum((~F.col(valid)).cast("long")).alias("total_errors"))
    first = bad.orderBy(idx).limit(show)
    return good, bad, totals, first
