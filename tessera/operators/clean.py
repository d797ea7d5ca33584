"""Projections, casts, clipping and imputation of a panel.

All functions are DataFrame -> DataFrame. Column lists default to the panel
spec and are matched against the input case-insensitively; absent columns are
skipped, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import PanelSpec, lookup_ci, present
from ..functions import exprs as X
from .ordering import exact_quantiles
from .scan import CUT, PLACED, entity_scan

INDEX_COLUMNS = ["Unnamed: 0", "_c0"]


# --------------------------------------------------------------- B: columns

def drop_index_columns(df: DataFrame) -> DataFrame:
    """B1: drop an exported row-index column (pandas names it ``Unnamed: 0``,
    Spark's CSV reader ``_c0``)."""
    return df.drop(*[c for c in df.columns if c in INDEX_COLUMNS])


def downcast(df: DataFrame, small_ints=("Gender", "SepsisLabel", "label")) -> DataFrame:
    """B2: flags to TINYINT and NaN -> NULL on every floating column. Floats
    stay DOUBLE (the reference's float32 would lose precision against the
    oracle)."""
    flags = present(df.columns, small_ints)
    changes = {c: F.col(c).cast("tinyint") for c in flags}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in changes:
            changes[f.name] = X.nan_to_null(F.col(f.name).cast("double"))
    return df.withColumns(changes) if changes else df


def feature_columns(df: DataFrame, spec: PanelSpec = PanelSpec()) -> list:
    """Every column not in the exclude set and not a key/label column."""
    drop = set(spec.exclude) | {x.lower() for x in [spec.entity, spec.time, spec.tie, spec.label, *PLACED, CUT] if x}
    return [c for c in df.columns if c.lower() not in drop]


def clip_outliers(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Winsorise each measure with a range to [low, high]; NULL stays NULL."""
    ranges = C.NORMAL_RANGES if ranges is None else ranges
    cols = present(df.columns, list(ranges))
    return df.withColumns({c: X.clip(c, *lookup_ci(ranges, c)) for c in cols}) if cols else df


def deterioration_score(df: DataFrame, rules=None, name: str = "vital_deterioration_score") -> DataFrame:
    """Number of measures outside their rule's bounds (0..len(rules)).
    A NULL measure counts 0, like a pandas comparison with NaN."""
    rules = C.DETERIORATION_RULES if rules is None else rules
    terms = []
    for m, lo, hi in rules:
        found = present(df.columns, [m])
        if found:
            terms.append(X.outside(found[0], lo, hi))
    score = F.lit(0)
    for t in terms:
        score = score + t
    return df.withColumn(name, score.cast("int"))


def add_missing_columns(df: DataFrame, names: list, value: float = 0.0) -> DataFrame:
    """Add each absent feature column as a constant (0.0)."""
    have = {c.lower() for c in df.columns}
    add = {n: F.lit(float(value)) for n in names if n.lower() not in have}
    return df.withColumns(add) if add else df


def binarize(df: DataFrame, p: str, threshold: float, out: str = "pred") -> DataFrame:
    """``(p >= threshold)`` as 0/1."""
    return df.withColumn(out, (F.col(p) >= X.dlit(threshold)).cast("int"))


def risk_levels(df: DataFrame, p: str, out: str = "risk_level") -> DataFrame:
    """HIGH >= 0.8, MEDIUM >= 0.5, else LOW."""
    return df.withColumn(out, X.risk_level(p))


def confidence_bands(df: DataFrame, p: str, out: str = "band") -> DataFrame:
    """Low < 0.3 <= mid <= 0.7 < high."""
    return df.withColumn(out, X.confidence_band(p))


def fill_invalid(df: DataFrame, cols: list, value: float = 0.5) -> DataFrame:
    """NaN/NULL predictions -> 0.5."""
    return df.withColumns({c: X.invalid_to(c, value) for c in cols})


def suffix_columns(df: DataFrame, suffix: str = "_pred", strip: bool = True) -> DataFrame:
    """Keep the columns ending in ``suffix``; optionally strip it."""
    cols = [c for c in df.columns if c.endswith(suffix)]
    if strip:
        return df.select(*[F.col(c).alias(c[: -len(suffix)]) for c in cols])
    return df.select(*cols)


# ------------------------------------------------------------ C: imputation

def locf_fill(df: DataFrame, spec: PanelSpec = PanelSpec(), cols: list | None = None,
              parts: int | None = None) -> DataFrame:
    """C1 + C2: per entity, forward fill then backward fill in time order
    (pandas ``ffill().bfill()``: a value is the last earlier non-NULL one,
    else the first later one)."""
    cols = present(df.columns, spec.measures) if cols is None else cols
    if not cols:
        return df
    s = entity_scan(df, spec.entity, spec.order_cols(), cols, ops=("ffill", "bfill"), parts=parts)
    return (s.withColumns({c: F.coalesce(F.col(f"{c}__ffill"), F.col(f"{c}__bfill")) for c in cols})
            .drop(*[f"{c}__{o}" for c in cols for o in ("ffill", "bfill")], "__idx"))


def column_medians(df: DataFrame, cols: list) -> dict:
    """Exact medians (``quantile_cont(0.5)``) of ``cols``, computed
    distributed; returns {column: median or None} - one number per column."""
    if not cols:
        return {}
    q = exact_quantiles(df, cols, [0.5])
    return {r["feature"]: r["q0"] for r in q.collect()}


def null_counts(df: DataFrame, cols: list) -> dict:
    """{column: number of NULLs}, one aggregate pass (partial aggregation)."""
    if not cols:
        return {}
    r = df.select(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]).first()
    return {c: (r[c] or 0) for c in cols}


def median_fill(df: DataFrame, cols: list, zero_when_all_null: bool = True, medians: dict | None = None) -> DataFrame:
    """C3 + C4: remaining NULLs -> the column's global median; a column with
    no value at all -> 0. Medians are computed only for columns that still
    hold a NULL, unless fitted ``medians`` ({column: median or None}) are
    given: then the frame is only projected."""
    if not cols:
        return df
    if medians is None:
        nulls = null_counts(df, cols)
        cols = [c for c in cols if nulls[c] > 0]
        if not cols:
            return df
        med = column_medians(df, cols)
    else:
        med = {c: lookup_ci(medians, c) for c in cols}
    fills = {}
    for c in cols:
        m = med.get(c)
        if m is None:
            fills[c] = F.lit(0.0) if zero_when_all_null else F.col(c)
        else:
            fills[c] = F.coalesce(F.col(c), X.dlit(m))
    return df.withColumns(fills)


def load_imputation(df: DataFrame, spec: PanelSpec = PanelSpec(), parts: int | None = None) -> DataFrame:
    """C1-C4 as the loader does it: per-entity ffill/bfill of every measure,
    then global medians, all-NULL columns -> 0."""
    cols = present(df.columns, spec.measures)
    return median_fill(locf_fill(df, spec, cols, parts), cols)


def lab_default_fill(df: DataFrame, spec: PanelSpec = PanelSpec(), medians: dict | None = None) -> DataFrame:
    """Each lab's NULLs -> its constant default; labs without a default
    (BaseExcess, PaCO2, Bilirubin_total) -> their median."""
    labs = present(df.columns, spec.labs)
    const = {c: lookup_ci(spec.lab_defaults, c) for c in labs}
    with_const = {c: F.coalesce(F.col(c), X.dlit(v)) for c, v in const.items() if v is not None}
    out = df.withColumns(with_const) if with_const else df
    rest = [c for c, v in const.items() if v is None]
    return median_fill(out, rest, zero_when_all_null=False, medians=medians)


def advanced_imputation(df: DataFrame, spec: PanelSpec = PanelSpec(), parts: int | None = None,
                        medians: dict | None = None) -> DataFrame:
    """C8 (with C6, C7): delta/trend NULL -> 0; vitals per-entity ffill, bfill,
    then median; labs -> defaults (C5); rolling max/min NULL -> the (imputed)
    base column; anything still NULL among the features -> 0. ``medians``:
    fitted ones instead of those of ``df``."""
    feats = feature_columns(df, spec)
    dt = [c for c in feats if "_delta" in c or "_trend" in c]
    out = df.fillna(0.0, subset=dt) if dt else df
    vitals = present(out.columns, spec.vitals)
    if vitals:
        # fill scans only for vitals that still hold a NULL (after the
        # loader's imputation usually none): one count pass decides
        nulls = null_counts(out, vitals)
        need = [c for c in vitals if nulls[c] > 0]
        if need:
            out = locf_fill(out, spec, need, parts)
            out = median_fill(out, need, zero_when_all_null=False, medians=medians)
    out = lab_default_fill(out, spec, medians)
    fills = {}
    for c in feats:
        if "_rolling_max" in c or "_rolling_min" in c:
            base = c.replace("_rolling_max", "").replace("_rolling_min", "")
            b = present(out.columns, [base])
            cur = F.coalesce(F.col(c), F.col(b[0])) if b else F.col(c)
        else:
            cur = F.col(c)
        fills[c] = F.coalesce(cur, F.lit(0).cast(out.schema[c].dataType))
    return out.withColumns(fills) if fills else out
