"""Ordered per-entity features.

All features of all measures come from one ``entity_scan`` (one exchange on
(entity, segment), one sort per direction), never a chain of per-column
windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelSpec, present
from .clean import deterioration_score
from .scan import entity_scan

FEATURE_SUFFIXES = ("delta", "rolling_max", "rolling_min", "trend")


def created_columns(measures: list, score: str | None = "vital_deterioration_score") -> list:
    """Names of the derived columns, in the reference's order."""
    out = [f"{m}_{s}" for m in measures for s in FEATURE_SUFFIXES]
    return out + ([score] if score else [])


def temporal_features(df: DataFrame, spec: PanelSpec = PanelSpec(), measures: list | None = None,
                      parts: int | None = None, score: bool = True) -> DataFrame:
    """For each measure m present:

    * ``m_delta``       = m - previous m (NULL on an entity's first row)      D2
    * ``m_rolling_max`` = running max of m (expanding, NULLs skipped)         D3
    * ``m_rolling_min`` = running min of m                                    D4
    * ``m_trend``       = least-squares slope over the last 3 rows, needs 2:  D5
      (m - m[-2]) / 2 with 3 rows, m - m[-1] with 2, NULL on the first row;
      NULL when a value in the window is NULL

    plus ``vital_deterioration_score`` (B5) on the same rows.
    """
    ms = present(df.columns, spec.measures if measures is None else measures)
    out = df
    if ms:
        s = entity_scan(df, spec.entity, spec.order_cols(), ms,
                        ops=("lag1", "lag2", "cummax", "cummin"), parts=parts)
        idx = F.col("__idx")
        feats = {}
        for m in ms:
            c, l1, l2 = F.col(m), F.col(f"{m}__lag1"), F.col(f"{m}__lag2")
            feats[f"{m}_delta"] = c - l1
            feats[f"{m}_rolling_max"] = F.col(f"{m}__cummax")
            feats[f"{m}_rolling_min"] = F.col(f"{m}__cummin")
            feats[f"{m}_trend"] = (F.when(idx >= 2, F.when(l1.isNotNull(), (c - l2) / F.lit(2.0)))
                                   .when(idx == 1, c - l1))
        out = s.select(*df.columns, *[v.alias(k) for k, v in feats.items()])
    if score:
        out = deterioration_score(out)
    return out
