"""Column-expression builders (JVM-side, codegen friendly).

Everything here returns a ``Column``; nothing touches data. Operators compose
these inside one ``select`` so Catalyst sees a single projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(x: float) -> Column:
    """A DOUBLE literal (a bare Python float is fine; this keeps intent)."""
    return F.lit(float(x))


def nan_to_null(c) -> Column:
    """NaN -> NULL. pandas has one missing value, Spark has two; every source
    normalises to NULL."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def clip(c, lo: float | None, hi: float | None) -> Column:
    """Winsorise to [lo, hi], keeping NULL (``greatest``/``least`` skip NULLs,
    so an unguarded clip would turn NULL into a bound)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, dlit(hi))
    if lo is not None:
        out = F.greatest(out, dlit(lo))
    return F.when(c.isNotNull(), out)


def outside(c, lo: float | None, hi: float | None) -> Column:
    """1 when c < lo or c > hi (strict), else 0; NULL compares false."""
    c = col(c)
    conds = []
    if hi is not None:
        conds.append(c > dlit(hi))
    if lo is not None:
        conds.append(c < dlit(lo))
    cond = reduce(lambda a, b: a | b, conds)
    return F.coalesce(cond.cast("int"), F.lit(0))


def risk_level(p) -> Column:
    p = col(p)
    return (F.when(p >= dlit(C.RISK_HIGH), "HIGH")
            .when(p >= dlit(C.RISK_MEDIUM), "MEDIUM")
            .otherwise("LOW"))


def confidence_band(p) -> Column:
    """low: p < 0.3, mid: 0.3 <= p <= 0.7, high: p > 0.7."""
    p = col(p)
    return (F.when(p < dlit(C.BAND_LOW), "low")
            .when(p <= dlit(C.BAND_HIGH), "mid")
            .otherwise("high"))


def agreement_level(std) -> Column:
    s = col(std)
    return (F.when(s < dlit(C.AGREEMENT_HIGH), "High")
            .when(s < dlit(C.AGREEMENT_MEDIUM), "Medium")
            .otherwise("Low"))


def invalid_to(p, fill: float = 0.5) -> Column:
    """NaN or NULL prediction -> ``fill`` (default 0.5)."""
    return F.coalesce(nan_to_null(p), dlit(fill))


# ---------------------------------------------------------------------------
# Row-wise statistics over a fixed list of columns (no arrays needed: the
# expressions are unrolled, which keeps them inside whole-stage codegen).
# ---------------------------------------------------------------------------

def row_sum(cols) -> Column:
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def row_mean(cols) -> Column:
    return row_sum(cols) / F.lit(float(len(cols)))


def row_std(cols, mean: Column | None = None) -> Column:
    """Population standard deviation (ddof 0) across the columns of a row."""
    m = row_mean(cols) if mean is None else mean
    ss = reduce(lambda a, b: a + b, [(col(c) - m) * (col(c) - m) for c in cols])
    return F.sqrt(ss / F.lit(float(len(cols))))


def row_min(cols) -> Column:
    return F.least(*[col(c) for c in cols]) if len(cols) > 1 else col(cols[0])


def row_max(cols) -> Column:
    return F.greatest(*[col(c) for c in cols]) if len(cols) > 1 else col(cols[0])


def row_median(cols) -> Column:
    """Median of the row (mean of the two middle values for an even count)."""
    arr = F.array_sort(F.array(*[col(c) for c in cols]))
    n = len(cols)
    if n % 2 == 1:
        return F.element_at(arr, n // 2 + 1)
    return (F.element_at(arr, n // 2) + F.element_at(arr, n // 2 + 1)) / F.lit(2.0)


def row_share(cols, pred) -> Column:
    """Share of the columns for which ``pred(column)`` holds."""
    hits = reduce(lambda a, b: a + b, [F.coalesce(pred(col(c)).cast("int"), F.lit(0)) for c in cols])
    return hits / F.lit(float(len(cols)))


def row_mad(cols, mean: Column | None = None) -> Column:
    """Mean absolute deviation from the row mean."""
    m = row_mean(cols) if mean is None else mean
    return reduce(lambda a, b: a + b, [F.abs(col(c) - m) for c in cols]) / F.lit(float(len(cols)))


def round6(c) -> Column:
    return F.round(col(c), 6)


EULER_GAMMA = 0.5772156649015329


def digamma(c) -> F.Column:
    """Digamma of whole numbers from 1: harmonic numbers up to 8, an asymptotic series (error below 1e-11) beyond."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    out = F.log(x) - 1 / (2 * x)
    for power, term in ((2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240), (10, -1 / 132)):
        out = out + dlit(term) / F.pow(x, F.lit(power))
    small = F.lit(None).cast("double")
    for n in range(8, 0, -1):
        small = F.when(x == n, dlit(sum(1 / j for j in range(1, n)) - EULER_GAMMA)).otherwise(small)
    return F.when(x <= 8, small).otherwise(out)
