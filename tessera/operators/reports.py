"""Report tables: the data behind each diagnostic chart.

Charts are not drawn; every function returns the table a chart would plot.
Histograms follow numpy exactly: ``bins`` equal-width bins over [min, max]
of each series (or one shared range), edges ``k * step + min`` with the last
edge ``max``, a value goes to bin k when edge_k <= x < edge_k+1 and the last
bin is closed; a constant series uses [x - 0.5, x + 0.5]. Empty bins are
kept (count 0).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .metrics import confusion
from .ordering import join_small, quantiles_by, unpivot


def _bin_index(x, mn, mx, bins: int):
    """numpy's histogram bin of x for [mn, mx] (mn < mx)."""
    step = (mx - mn) / F.lit(float(bins))
    idx0 = F.floor((x - mn) / (mx - mn) * F.lit(float(bins))).cast("int")
    idx0 = F.least(F.greatest(idx0, F.lit(0)), F.lit(bins - 1))

    def edge(k):
        return F.when(k >= F.lit(bins), mx).otherwise(k.cast("double") * step + mn)

    dec = F.when(x < edge(idx0), idx0 - 1).otherwise(idx0)
    return F.when((x >= edge(dec + 1)) & (dec != F.lit(bins - 1)), dec + 1).otherwise(dec)


def histogram(df: DataFrame, value: str, groups=(), bins: int = 30, shared: bool = False) -> DataFrame:
    """Counts per (groups, bin) with bin edges, density count/(n*width) and
    the series mean. ``shared`` uses one range over all groups (two numbers
    read back). The per-group table has one row per group and is joined
    back after a size check."""
    user_groups = list(groups)
    groups = user_groups or ["__g"]
    x = F.col(value).cast("double")
    data = df.select(*[F.col(g) for g in user_groups], x.alias("__x"))
    if not user_groups:
        data = data.withColumn("__g", F.lit(0))
    data = data.filter(F.col("__x").isNotNull())
    stats = data.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("series_mean"),
                                      F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    if shared:
        r = data.agg(F.min("__x").alias("a"), F.max("__x").alias("b")).first()
        stats = stats.withColumns({"__mn": F.lit(r["a"]).cast("double"), "__mx": F.lit(r["b"]).cast("double")})
    same = F.col("__mn") == F.col("__mx")
    stats = stats.select(*groups, "n", "series_mean",
                         F.when(same, F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("__lo"),
                         F.when(same, F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("__hi"))
    joined = join_small(data, stats.select(*groups, "__lo", "__hi"), groups)
    binned = joined.select(*groups, _bin_index(F.col("__x"), F.col("__lo"), F.col("__hi"), bins).alias("bin"))
    counts = binned.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("count"))
    step = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    grid = stats.select(*groups, "n", "series_mean", "__lo", "__hi",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*groups, "bin"], "left").select(
        *user_groups, "bin",
        (F.col("bin").cast("double") * step + F.col("__lo")).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("__hi"))
         .otherwise((F.col("bin") + 1).cast("double") * step + F.col("__lo")).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        "n", "series_mean")
    return out.withColumn("density", F.col("count") / (F.col("n") * (F.col("hi") - F.col("lo"))))


# ----------------------------------------------------------- I1 - I5

def prediction_histograms(long: DataFrame, bins: int = 30) -> DataFrame:
    """I1 (30 bins) / I5 (20 bins): density histogram of p per model."""
    return histogram(long, "p", ["model"], bins)


def disagreement_histogram(meta: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of ``disagreement`` with its mean."""
    return histogram(meta, "disagreement", [], bins)


def confidence_histogram(meta: DataFrame, bins: int = 30) -> DataFrame:
    """high/low confidence shares on one shared range."""
    lg = unpivot(meta.select("high_confidence", "low_confidence"), [], ["high_confidence", "low_confidence"],
                 "series", "value")
    return histogram(lg, "value", ["series"], bins, shared=True)


def ensemble_stat_correlation(meta: DataFrame) -> DataFrame:
    """I4: |corr| of ensemble mean/std/range with the ensemble mean."""
    stats = ["ensemble_mean", "ensemble_std", "ensemble_range"]
    one = meta.select(*[F.abs(F.corr(c, "ensemble_mean")).alias(c) for c in stats])
    return unpivot(one, [], stats, "stat", "abs_corr")


# ----------------------------------------------------------- I7 - I12

def with_error(long_one: DataFrame) -> DataFrame:
    """(row_id, y, p, error = |p - y|)."""
    return long_one.select("row_id", "y", "p", F.abs(F.col("p") - F.col("y")).alias("error"))


def error_box_stats(long_one: DataFrame) -> DataFrame:
    """Box statistics of |p - y| by confidence band (<0.3, 0.3-0.7,
    >0.7): count, exact quartiles, whiskers (extreme values within 1.5 IQR
    of the box) and outlier count."""
    e = with_error(long_one).withColumn("band", X.confidence_band("p"))
    q = quantiles_by(e, ["band"], "error", [0.25, 0.5, 0.75]).select(
        "band", F.col("q0").alias("lower_q"), F.col("q1").alias("median"), F.col("q2").alias("upper_q"))
    q = q.withColumnsRenamed({"lower_q": "q1", "upper_q": "q3"})
    j = join_small(e, q, "band", bound=3)  # three bands
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col("error") >= lo) & (F.col("error") <= hi)
    return j.groupBy("band", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.when(inside, F.col("error"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("error"))).alias("whisker_high"),
        F.sum((~inside).cast("int")).alias("outliers"))


def outcome_shares(long_one: DataFrame, threshold: float = 0.5) -> DataFrame:
    """I8: TP/TN/FP/FN counts and percent of all rows."""
    c = confusion(long_one.withColumn("model", F.lit("ensemble")), [threshold])
    lg = c.selectExpr("stack(4, 'True Pos', tp, 'True Neg', tn, 'False Pos', fp, 'False Neg', fn) AS (outcome, count)")
    w = Window.partitionBy()  # four rows
    return lg.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(w))


def error_agreement(wide: DataFrame, ensemble: str, base_cols: list, threshold: float = 0.5) -> DataFrame:
    """On rows the ensemble gets wrong at ``threshold``, how many base
    models vote positive -> number of rows."""
    pred = (F.col(ensemble) >= X.dlit(threshold)).cast("int")
    votes = sum(((F.col(c) >= X.dlit(threshold)).cast("int") for c in base_cols), F.lit(0))
    return (wide.filter(pred != F.col("y")).select(votes.alias("models_positive"))
            .groupBy("models_positive").agg(F.count(F.lit(1)).alias("count")))


def error_histogram_by_class(long_one: DataFrame, bins: int = 30) -> DataFrame:
    """|p - y| histograms per true class on a shared range."""
    return histogram(with_error(long_one), "error", ["y"], bins, shared=True)


def high_error_histogram(long_one: DataFrame, pct: float = 0.9, bins: int = 20) -> DataFrame:
    """Rows with error >= the 90th percentile (linear); histogram of
    their probabilities."""
    e = with_error(long_one)
    cut = quantiles_by(e.withColumn("__g", F.lit(0)), ["__g"], "error", [pct])
    hi = join_small(e.withColumn("__g", F.lit(0)), cut, "__g", bound=1).filter(F.col("error") >= F.col("q0"))
    return histogram(hi, "p", [], bins)


# ---------------------------------------------------------- I13 - I19

def model_band_table(long: DataFrame) -> DataFrame:
    """Per model and row: class, probability and its band
    (low < 0.3 <= mid <= 0.7 < high) and side of 0.5."""
    return long.select("model", "row_id", "y", "p", X.confidence_band("p").alias("band"),
                       (F.col("p") >= X.dlit(0.5)).cast("int").alias("above_half"))


def confidence_by_class(long: DataFrame, bins: int = 25) -> DataFrame:
    """Density histogram per (model, true class), with class size
    (``n``) and class mean (``series_mean``)."""
    return histogram(long, "p", ["model", "y"], bins)


def row_uncertainty(wide: DataFrame, base_cols: list) -> DataFrame:
    """Per row mean/std/min/max over models and |mean - y|."""
    m = X.row_mean(base_cols)
    return wide.select("row_id", "y", m.alias("mean"), X.row_std(base_cols, m).alias("std"),
                       X.row_min(base_cols).alias("min"), X.row_max(base_cols).alias("max"),
                       F.abs(m - F.col("y")).alias("error"))


def uncertainty_histograms(unc: DataFrame, bins: int = 30) -> DataFrame:
    """I16: histograms (with means) of the row std and of max - min."""
    lg = unpivot(unc.select(F.col("std"), (F.col("max") - F.col("min")).alias("range")),
                 [], ["std", "range"], "series", "value")
    return histogram(lg, "value", ["series"], bins)


def high_uncertainty_cases(unc: DataFrame, pct: float = 0.75) -> DataFrame:
    """Rows whose std is strictly above its 75th percentile."""
    g = unc.withColumn("__g", F.lit(0))
    cut = quantiles_by(g, ["__g"], "std", [pct])
    return (join_small(g, cut, "__g", bound=1).filter(F.col("std") > F.col("q0"))
            .select("row_id", "y", "mean", "std"))


def decision_bins(long: DataFrame, n_bins: int = 20) -> DataFrame:
    """I18 + I19: fixed bins [k/20, (k+1)/20) of p (p = 1.0 falls in none):
    observed positive rate and count (0 for empty bins), and count scaled by
    the model's largest bin."""
    edges = [k * (1.0 / n_bins) for k in range(n_bins + 1)]
    edges[-1] = 1.0
    b = sum(((F.col("p") >= X.dlit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    inr = (F.col("p") >= X.dlit(0.0)) & (F.col("p") < X.dlit(1.0))
    cnt = (long.filter(inr).withColumn("bin", b).groupBy("model", "bin")
           .agg(F.count(F.lit(1)).alias("count"), F.avg(F.col("y").cast("double")).alias("positive_rate")))
    models = long.select("model").distinct()
    grid = models.select("model", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    t = grid.join(cnt, ["model", "bin"], "left").select(
        "model", "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("positive_rate", F.lit(0.0)).alias("positive_rate"))
    w = Window.partitionBy("model")  # n_bins rows per model
    return t.withColumn("count_scaled", F.when(F.max("count").over(w) > 0,
                                               F.col("count") / F.max("count").over(w)).otherwise(F.lit(0.0)))


# ---------------------------------------------------------- I20 - I24

def correlation_pairs(df: DataFrame, cols: list, lower_only: bool = True) -> DataFrame:
    """Pearson r for every pair (a, b) with a after b in ``cols``
    (strict lower triangle), pairwise complete (rows with a NULL in either
    column are skipped). One aggregate pass."""
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(len(cols))
             if (i > j if lower_only else True)]
    one = df.select(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
                      for i, (a, b) in enumerate(pairs)])
    parts = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {parts}) AS (a, b, r)")


def correlation_matrix(df: DataFrame, cols: list) -> DataFrame:
    """Full Pearson matrix of many columns, long (a, b, r), over the rows in which both columns
    of a pair are given. Without NULLs that is Spark ML's distributed Gramian (one pass); a matrix
    with NULLs takes one ``corr`` aggregate per pair, some hundred to a pass. The result is
    len(cols)^2 numbers."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    schema = "a string, b string, r double"
    if d.where(F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0)) > 0).isEmpty() and not d.isEmpty():
        va = VectorAssembler(inputCols=cols, outputCol="__v", handleInvalid="keep")
        m = Correlation.corr(va.transform(d), "__v").head()[0].toArray()
        rows = [(a, b, float(m[i][j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
        return df.sparkSession.createDataFrame(rows, schema)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    found = {}
    for k in range(0, len(pairs), 200):
        some = pairs[k:k + 200]
        found.update(zip(some, d.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(some)]).first(), strict=True))
    return df.sparkSession.createDataFrame([(a, b, found.get((a, b), found.get((b, a)))) for a in cols for b in cols], schema)


def top_importances(imp: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest importances (a top-k report)."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def top_contributions(long: DataFrame, key: str, name: str, value: str, k: int = 15) -> DataFrame:
    """Per ``key``, the ``k`` values with the largest |value| (ties by
    name), their sign and the running total in that order (waterfall). Rank
    and total come from one sort, and the ``rank <= k`` filter becomes a
    partial per-group limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.abs(F.col(value)).desc(), F.col(name))
    t = long.withColumns({
        "rank": F.row_number().over(w),
        "running_total": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))}).filter(F.col("rank") <= k)
    return t.select(key, "rank", name, value,
                    F.when(F.col(value) < 0, "negative").otherwise("positive").alias("sign"), "running_total")


def row_top(df: DataFrame, key: str, cols: list, name: str, value: str, k: int = 15) -> DataFrame:
    """Wide -> long (key, name, value) with those columns of each row that are among its first
    ``k`` by |value| (NaN first, NULL last) or tie with the last of them. What ``top_contributions``
    ranks of these is what it ranks of all columns, also where rows share a key, and a row's other
    columns never become rows that are sorted."""
    v = lambda c: F.col(c).cast("double")
    # ascending: NaN before all, NULL (as NaN, the greatest double) behind all
    size = lambda c: F.when(F.isnan(v(c)), F.lit(-math.inf)).otherwise(F.coalesce(-F.abs(v(c)), F.lit(math.nan)))
    cut = df.withColumn("__cut", F.sort_array(F.array(*[size(c) for c in cols]))[min(k, len(cols)) - 1])
    first = F.array_compact(F.array(*[F.when(size(c) <= F.col("__cut"), F.struct(F.lit(c).alias("c"), v(c).alias("v"))) for c in cols]))
    return cut.select(key, F.explode(first).alias("__t")).select(key, F.col("__t.c").alias(name), F.col("__t.v").alias(value))
