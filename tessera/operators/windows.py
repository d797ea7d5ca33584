"""Fixed-length windows per entity and robust scaling.

The window table is kept long - one row per (entity, step) - until a model
needs a vector; steps are 0..n-1, real rows at the end, zero rows in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import PanelSpec, present
from ..functions import exprs as X
from .clean import (add_missing_columns, advanced_imputation, clip_outliers, deterioration_score,
                    feature_columns, locf_fill, median_fill)
from .ordering import exact_quantiles
from .scan import place
from .temporal import created_columns, temporal_features


def last_rows(df: DataFrame, spec: PanelSpec = PanelSpec(), n: int = C.TIME_WINDOW) -> DataFrame:
    """The last ``n`` rows of each entity, with ``step`` = n-1 for the
    last row, n-2 for the one before, ... The ``row_number() <= n`` filter
    lets Catalyst put a partial per-entity limit before the shuffle
    (WindowGroupLimit), so a huge entity sends only n rows per map task."""
    w = Window.partitionBy(spec.entity).orderBy(*[F.col(c).desc() for c in spec.order_cols()])
    return (df.withColumn("__rd", F.row_number().over(w))
            .filter(F.col("__rd") <= n)
            .withColumn("step", (F.lit(n) - F.col("__rd")).cast("int"))
            .drop("__rd"))


def pad_front(last: DataFrame, spec: PanelSpec, features: list, n: int = C.TIME_WINDOW) -> DataFrame:
    """Add zero rows at steps 0..n-k-1 for entities with k < n rows.
    Only the missing steps are generated (no grid join)."""
    have = last.groupBy(spec.entity).agg(F.min("step").alias("__first"))
    pads = (have.filter(F.col("__first") > 0)
            .select(spec.entity, F.explode(F.sequence(F.lit(0), F.col("__first") - 1)).alias("step")))
    real = last.select(spec.entity, "step", *features, F.lit(False).alias("is_pad"))
    zeros = pads.select(spec.entity, "step", *[F.lit(0.0).alias(f) for f in features],
                        F.lit(True).alias("is_pad"))
    return real.unionByName(zeros)


def last_label(df: DataFrame, spec: PanelSpec = PanelSpec(), out: str = "y") -> DataFrame:
    """The label of each entity's last row (0 when there is no label
    column)."""
    lab = present(df.columns, [spec.label]) if spec.label else []
    if not lab:
        return df.select(spec.entity).distinct().withColumn(out, F.lit(0))
    key = F.struct(*[F.col(c) for c in spec.order_cols()])
    return df.groupBy(spec.entity).agg(F.max_by(F.col(lab[0]), key).cast("int").alias(out))


def window_arrays(long: DataFrame, spec: PanelSpec, features: list, out: str = "window") -> DataFrame:
    """One row per entity with ``window`` = array of n arrays (time-major),
    collected from the n long rows of the entity (bounded per group)."""
    rows = F.struct(F.col("step"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    g = long.groupBy(spec.entity).agg(F.array_sort(F.collect_list(rows)).alias("__w"))
    return g.select(spec.entity, F.transform("__w", lambda x: x["v"]).alias(out))


def flatten_window(df: DataFrame, col: str = "window", out: str = "flat") -> DataFrame:
    """N x f window -> one time-major array of n*f values."""
    return df.withColumn(out, F.flatten(F.col(col)))


def to_vector(df: DataFrame, col: str = "flat", out: str = "features") -> DataFrame:
    """array<double> -> ML vector."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(col)))


def robust_scaler_fit(long: DataFrame, features: list, include_padding: bool = False) -> DataFrame:
    """Per feature median and IQR (q75 - q25, linear interpolation) over
    (entity x step) rows; IQR 0 -> scale 1. Padding rows are left out unless
    ``include_padding`` (the reference fits on them). Returns a table
    (feature, center, scale) with one row per feature."""
    src = long
    if not include_padding and "is_pad" in long.columns:
        src = long.filter(~F.col("is_pad"))
    q = exact_quantiles(src, features, [0.25, 0.5, 0.75])
    iqr = F.col("q2") - F.col("q0")
    return q.select("feature", F.col("q1").alias("center"),
                    F.when(iqr.isNull() | (iqr == 0), F.lit(1.0)).otherwise(iqr).alias("scale"))


def robust_scale(long: DataFrame, stats: DataFrame, features: list) -> DataFrame:
    """(x - center) / scale with fitted stats. The stats table has one
    row per feature, so it is read once and applied as literals."""
    st = {r["feature"]: (r["center"], r["scale"]) for r in stats.collect()}
    upd = {}
    for f in features:
        c, s = st.get(f, (None, None))
        c = 0.0 if c is None else c
        s = 1.0 if s is None else s
        upd[f] = (F.col(f) - X.dlit(c)) / X.dlit(s)
    return long.withColumns(upd)


def window_features(df: DataFrame, spec: PanelSpec = PanelSpec(), features: str = "all") -> list:
    """Feature list of the window table: raw feature columns, then the
    derived ones (``features="all"``, intended semantics) or raw only
    (``"raw"``, what the reference's selection effectively uses)."""
    raw = [c for c in feature_columns(df, spec) if c not in set(created_columns(present(df.columns, spec.measures)))]
    if features == "raw":
        return raw
    return raw + created_columns(present(df.columns, spec.measures))


def panel_features(df: DataFrame, spec: PanelSpec = PanelSpec(), impute_on_load: bool = True,
                   score_after_clip: bool = False, parts: int | None = None, medians: dict | None = None) -> DataFrame:
    """The row-level part of D14: load imputation -> clip -> temporal features
    -> advanced imputation. ``medians``: fitted ones instead of those of ``df``."""
    # one placed table serves every ordered scan; fitted statistics (medians,
    # scaler) read their input once more, so that input is written once to the
    # shared checkpoint folder instead of running the scans again
    base = place(df, spec.entity, spec.order_cols(), parts)
    if impute_on_load:
        ms = present(df.columns, spec.measures)
        filled = locf_fill(base, spec, ms)
        base = median_fill(filled.checkpoint() if medians is None else filled, ms, medians=medians)
    return derived_features(base, spec, score_after_clip, medians)


def derived_features(base: DataFrame, spec: PanelSpec = PanelSpec(), score_after_clip: bool = False,
                     medians: dict | None = None) -> DataFrame:
    """Clip -> temporal features -> advanced imputation of a placed panel."""
    if score_after_clip:
        feats_df = temporal_features(clip_outliers(base, spec.ranges), spec)
    else:
        # the score is a row-wise projection: take it on unclipped values
        # (see SURVEY Q4), then clip and derive the ordered features
        feats_df = temporal_features(clip_outliers(deterioration_score(base), spec.ranges),
                                     spec, score=False)
    return advanced_imputation(feats_df, spec, medians=medians)


def cut_windows(rows: DataFrame, spec: PanelSpec, features: list, n: int = C.TIME_WINDOW) -> DataFrame:
    """Absent features as 0 (B6), the last ``n`` rows per entity, zero padding; unscaled."""
    return pad_front(last_rows(add_missing_columns(rows, features), spec, n), spec, features, n)


def prepare_windows(df: DataFrame, spec: PanelSpec = PanelSpec(), n: int = C.TIME_WINDOW,
                    stats: DataFrame | None = None, features: str = "all",
                    impute_on_load: bool = True, score_after_clip: bool = False,
                    include_padding: bool = False, parts: int | None = None):
    """Load imputation -> clip -> temporal features -> advanced
    imputation -> missing features as 0 -> last n rows per entity with zero
    padding -> label of the last row -> robust scaling (fitted here when
    ``stats`` is None, i.e. on training data).

    Returns (long window table, labels table, stats table, feature list).
    """
    imputed = panel_features(df, spec, impute_on_load, score_after_clip, parts)
    flist = window_features(df, spec, features)
    long = cut_windows(imputed, spec, flist, n).checkpoint()
    labels = last_label(df, spec)
    if stats is None:
        stats = robust_scaler_fit(long, flist, include_padding)
    return robust_scale(long, stats, flist), labels, stats, flist
