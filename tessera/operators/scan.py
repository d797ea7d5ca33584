"""Per-entity ordered scans that survive a hot entity.

Forward/backward fill, lags, cumulative max/min and row positions all need
the rows of one entity in time order. A plain ``Window.partitionBy(entity)``
sends a whole entity to one task; if one entity holds a third of the data,
that task holds a third of the data.

There is one plan for every size. ``place`` counts rows per entity and cuts
each entity that holds more than two shares (one share: all rows by the number
of shuffle partitions) into segments of about a share, by bounds from a sample of
its own rows in order. The segment is an expression of the row, so nothing is moved or
written for it; all other entities are one segment. ``entity_scan`` runs the
window per (entity, segment) after one exchange, summarises the segments of cut
entities (row count, max, min, last and first non-NULL value, last two values),
scans the summaries per entity to get what flows in from earlier (or, for the
backward fill, later) segments, and joins that carry back on (entity, segment).
Cut entities have together at most twice as many segments as there are shares;
where no entity is cut, the optimizer removes summaries and join. The scanned
rows are already hash-partitioned and sorted on (entity, segment) by the
window, so the join moves only the summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What ``place`` adds: the entity without NULL, whether it was NULL, the segment, whether the entity is cut.
KEY, SEGMENT, CUT = ["__entity", "__no_entity"], "__seg", "__cut"
PLACED = [*KEY, SEGMENT]
# Rows sampled per share to find bounds.
PER_SHARE = 50


def _keyed(df: DataFrame, entity: str) -> DataFrame:
    return df.withColumns({KEY[0]: F.coalesce(F.col(entity), F.lit("0").cast(df.schema[entity].dataType)), KEY[1]: F.col(entity).isNull()})


def _bounds(keyed: DataFrame, order: list, n: int) -> DataFrame | None:
    """(KEY, __bounds): for each entity of more than two shares the first ``order`` values of its
    segments but the first, in order; at most n rows with together at most 2 n bounds. None if there is no such entity."""
    share = keyed.count() / n
    hot = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > F.lit(2 * share)).collect()  # fewer than n / 2 rows
    if not hot:
        return None
    spark = keyed.sparkSession
    key_type = keyed.select(*KEY).schema
    entities = spark.createDataFrame([(r[KEY[0]], r[KEY[1]]) for r in hot], key_type)
    theirs = keyed.select(*KEY, F.struct(*order).alias("at")).join(F.broadcast(entities), KEY, "left_semi")  # at most n / 2 rows
    some = theirs.sample(min(1.0, PER_SHARE / max(share, 1.0)), seed=42)  # at most about PER_SHARE * n rows
    w = Window.partitionBy(*KEY)
    step = F.greatest(F.lit(1), F.floor(F.col("sampled") / F.ceil(F.col("sampled") / F.lit(min(PER_SHARE, max(share, 1.0))))))
    cuts = (some.select("*", F.row_number().over(w.orderBy("at")).alias("nth"), F.count(F.lit(1)).over(w).alias("sampled"))
            .where((F.col("nth") > 1) & ((F.col("nth") - 1) % step == 0))
            .groupBy(*KEY).agg(F.array_sort(F.collect_set("at")).alias("__bounds")))
    # read back once, so that every later pass sees the same bounds
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def place(df: DataFrame, entity: str, order: list, parts: int | None = None) -> DataFrame:
    """``df`` with each row's entity key and segment. ``df`` is counted per entity here, and the
    rows of cut entities are sampled; the bounds are fixed values of the plan, so summaries and
    rows see the same segments. Several scans may share one placed table. ``parts`` is the
    number of shares (default: the session's shuffle partitions)."""
    n = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = _keyed(df, entity)
    bounds = _bounds(keyed, order, n)
    if bounds is None:
        return keyed.withColumns({SEGMENT: F.lit(0), CUT: F.lit(False)})
    at = F.struct(*order)
    seg = F.size(F.filter("__bounds", lambda b: b <= at))
    return (keyed.join(F.broadcast(bounds), KEY, "left")  # at most n rows and 2 n bounds
            .withColumns({SEGMENT: F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(seg), CUT: F.col("__bounds").isNotNull()})
            .select(*keyed.columns, SEGMENT, CUT))


OPS = ("ffill", "bfill", "lag1", "lag2", "cummax", "cummin")


def entity_scan(df: DataFrame, entity: str, order: list, cols: list,
                ops=OPS, parts: int | None = None, with_count: bool = False) -> DataFrame:
    """Return ``df`` plus, for every ``c`` in ``cols`` and op in ``ops``,
    a column ``{c}__{op}``:

    * ``ffill``: last non-NULL value at or before the row (NULL before the
      first value), ``bfill``: first non-NULL value at or after the row,
    * ``lag1``/``lag2``: the value one/two rows earlier (NULL if none),
    * ``cummax``/``cummin``: running max/min of the non-NULL values so far,

    and ``__idx`` (0-based position of the row in its entity) and, with
    ``with_count``, ``__n`` (row count of the entity). The full ``order`` must
    be unique per entity for a deterministic result. A ``df`` that ``place``
    has given segments for this order is scanned as it is; any other is placed
    first.
    """
    ops = tuple(ops)
    seg = SEGMENT
    d = df if seg in df.columns else place(df, entity, order, parts)
    asc = [F.col(c).asc() for c in order]
    desc = [F.col(c).desc() for c in order]
    wl = Window.partitionBy(*KEY, seg).orderBy(*asc)
    run = wl.rowsBetween(Window.unboundedPreceding, 0)
    run_desc = Window.partitionBy(*KEY, seg).orderBy(*desc).rowsBetween(Window.unboundedPreceding, 0)

    loc_cols = [F.row_number().over(wl).alias("__rn")]
    for c in cols:
        if "lag1" in ops or "lag2" in ops:
            loc_cols.append(F.lag(c, 1).over(wl).alias(f"{c}__l1"))
        if "lag2" in ops:
            loc_cols.append(F.lag(c, 2).over(wl).alias(f"{c}__l2"))
        if "cummax" in ops:
            loc_cols.append(F.max(c).over(run).alias(f"{c}__mx"))
        if "cummin" in ops:
            loc_cols.append(F.min(c).over(run).alias(f"{c}__mn"))
        if "ffill" in ops:
            loc_cols.append(F.last(c, ignorenulls=True).over(run).alias(f"{c}__ff"))
        if "bfill" in ops:
            loc_cols.append(F.last(c, ignorenulls=True).over(run_desc).alias(f"{c}__bf"))
    if with_count:
        loc_cols.append(F.count(F.lit(1)).over(Window.partitionBy(*KEY, seg)).alias("__here"))
    loc = d.select("*", *loc_cols)

    # --- segment summaries of cut entities ---
    ordstruct = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("__cnt")]
    for c in cols:
        nn = F.when(F.col(c).isNotNull(), ordstruct)
        if "cummax" in ops:
            aggs.append(F.max(c).alias(f"{c}__smx"))
        if "cummin" in ops:
            aggs.append(F.min(c).alias(f"{c}__smn"))
        if "ffill" in ops:
            aggs.append(F.max_by(F.col(c), nn).alias(f"{c}__slnn"))
        if "bfill" in ops:
            aggs.append(F.min_by(F.col(c), nn).alias(f"{c}__sfnn"))
        if "lag1" in ops or "lag2" in ops:
            aggs.append(F.max_by(F.struct(F.col(c).alias("v1"), F.col(f"{c}__l1").alias("v2")),
                                 ordstruct).alias(f"{c}__slast"))
    summ = loc.where(CUT).groupBy(*KEY, seg).agg(*aggs)

    ws = Window.partitionBy(*KEY).orderBy(seg)
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*KEY).orderBy(F.col(seg).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.sum("__cnt").over(prev).alias("__off")]
    if with_count:
        carry_cols.append(F.sum("__cnt").over(Window.partitionBy(*KEY)).alias("__all"))
    for c in cols:
        if "cummax" in ops:
            carry_cols.append(F.max(f"{c}__smx").over(prev).alias(f"{c}__kmx"))
        if "cummin" in ops:
            carry_cols.append(F.min(f"{c}__smn").over(prev).alias(f"{c}__kmn"))
        if "ffill" in ops:
            carry_cols.append(F.last(f"{c}__slnn", ignorenulls=True).over(prev).alias(f"{c}__kff"))
        if "bfill" in ops:
            carry_cols.append(F.last(f"{c}__sfnn", ignorenulls=True).over(later).alias(f"{c}__kbf"))
        if "lag1" in ops or "lag2" in ops:
            carry_cols.append(F.lag(F.col(f"{c}__slast.v1"), 1).over(ws).alias(f"{c}__kl1"))
        if "lag2" in ops:
            carry_cols.append(
                F.when(F.lag("__cnt", 1).over(ws) >= 2, F.lag(F.col(f"{c}__slast.v2"), 1).over(ws))
                .otherwise(F.lag(F.col(f"{c}__slast.v1"), 2).over(ws)).alias(f"{c}__kl2"))
    carry = summ.select(*KEY, seg, *carry_cols)

    out = loc.join(carry, PLACED, "left")
    out = out.withColumn("__idx", (F.coalesce("__off", F.lit(0)) + F.col("__rn") - 1).cast("long"))
    if with_count:
        out = out.withColumn("__n", F.coalesce("__all", "__here"))
    rn = F.col("__rn")
    finals = {}
    for c in cols:
        if "ffill" in ops:
            finals[f"{c}__ffill"] = F.coalesce(F.col(f"{c}__ff"), F.col(f"{c}__kff"))
        if "bfill" in ops:
            finals[f"{c}__bfill"] = F.coalesce(F.col(f"{c}__bf"), F.col(f"{c}__kbf"))
        if "lag1" in ops:
            finals[f"{c}__lag1"] = F.when(rn == 1, F.col(f"{c}__kl1")).otherwise(F.col(f"{c}__l1"))
        if "lag2" in ops:
            finals[f"{c}__lag2"] = (F.when(rn == 1, F.col(f"{c}__kl2"))
                                    .when(rn == 2, F.col(f"{c}__kl1"))
                                    .otherwise(F.col(f"{c}__l2")))
        if "cummax" in ops:
            finals[f"{c}__cummax"] = F.greatest(F.col(f"{c}__mx"), F.col(f"{c}__kmx"))
        if "cummin" in ops:
            finals[f"{c}__cummin"] = F.least(F.col(f"{c}__mn"), F.col(f"{c}__kmn"))
    return _finish(out, finals, df.columns)


def _finish(out: DataFrame, finals: dict, original: list) -> DataFrame:
    keep = set(original) | set(finals) | {"__idx", "__n"}
    helper = [c for c in out.columns if c not in keep]
    return out.withColumns(finals).drop(*helper)
