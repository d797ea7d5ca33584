"""Global order without a one-task window.

A window without ``partitionBy`` (or partitioned by a handful of keys, such as
a model name or a class label) puts every row of the group in one task. The
helpers here give the same answers with work spread over all tasks:

* ``ordinal_rank``: 0-based position of each row inside its group under a
  total order. Rows are range-partitioned on (group, order) - the sampled
  bounds split even one huge group, or heavy ties of the order key, across
  many partitions because the order must include a unique tie-breaker -
  sorted inside each partition, numbered with ``monotonically_increasing_id``
  (partition id in the upper bits, position in the lower bits), and shifted by
  the row count of the same group in earlier partitions. The offset table has
  one row per (partition, group) pair, so its size is bounded by
  partitions + groups; it is broadcast only after that size is checked.

* ``prefix_sums``: running sums of count columns in score order, per group,
  on a table that has one row per distinct (group, score) - callers aggregate
  duplicates first, so no score can be a hot key. Scores are cut into
  quantile buckets (``approxQuantile`` + ``Bucketizer``), running sums are
  computed per (group, bucket) with a normal window, and bucket totals give
  each bucket its offset.

* ``quantiles_by``, ``exact_quantiles``: exact ``quantile_cont`` from running
  counts of distinct values, per group or for many columns at once (no value
  histogram in one task).
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = 33
LOW_MASK = (1 << LOW_BITS) - 1

# Largest offset/stat table that is broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 200_000


def _nparts(df: DataFrame, nparts: int | None) -> int:
    if nparts:
        return nparts
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def parts_for(spark, rows: int, per_task: int = 1_000_000) -> int:
    """Partitions for ``rows`` rows: the session's number, more where a task would get over ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, math.ceil(rows / per_task))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS, bound: int | None = None) -> DataFrame:
    """Join a derived table whose size is bounded by construction, after
    checking it: broadcast when it has at most ``max_rows`` rows, otherwise a
    regular (shuffle) join. ``bound`` is an upper bound on the row count
    known from construction (e.g. partitions + groups); when it is given the
    count is not run."""
    n = bound if bound is not None else small.count()
    if n <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def ordinal_rank(df: DataFrame, group_cols: list, order_cols: list,
                 out: str = "rank", nparts: int | None = None,
                 ngroups: int | None = None, keep: list | None = None) -> DataFrame:
    """Add ``out``: 0-based position of each row inside ``group_cols`` when
    sorted by ``order_cols`` ascending (pass Columns with ``.desc()`` for
    descending). ``order_cols`` must make rows unique inside a group, or
    ties come out in an arbitrary but repeatable order. With ``keep`` only those
    columns and the groups are stored and returned, as Parquet files, which
    take a fraction of a checkpoint's bytes."""
    n = _nparts(df, nparts)
    keys = [F.col(c) if isinstance(c, str) else c for c in list(group_cols) + list(order_cols)]
    ranged = (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("__mid", F.monotonically_increasing_id())
              .withColumn("__pid", F.shiftright(F.col("__mid"), LOW_BITS))
              .withColumn("__loc", F.col("__mid").bitwiseAND(F.lit(LOW_MASK))))
    # The per-partition counts and the rows must see the same partitioning,
    # but range bounds are re-sampled on every execution (the sampler is
    # seeded by RDD id). So the tagged rows are written once to the shared
    # checkpoint folder (reliable: survives executor loss) and both branches
    # read that copy.
    from ..session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(df.sparkSession)
    if keep is None:
        ranged = ranged.checkpoint(eager=True)
    else:
        ranged = ranged.select(*dict.fromkeys([*group_cols, *keep]), "__pid", "__loc")
        path = f"{folder.rstrip('/')}/tessera-rank-{uuid.uuid4().hex}"
        ranged.write.parquet(path)
        ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    stats = ranged.groupBy("__pid", *group_cols).agg(
        F.count(F.lit(1)).alias("__cnt"), F.min("__loc").alias("__first"))
    w = Window.partitionBy(*group_cols).orderBy("__pid") if group_cols else Window.orderBy("__pid")
    offs = stats.select(
        "__pid", *group_cols, "__first",
        F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    # (partition, group) pairs: at most partitions + groups - 1 rows
    bound = None if (group_cols and ngroups is None) else n + (ngroups or 1)
    res = join_small(ranged, offs, ["__pid", *group_cols], bound=bound)
    return (res.withColumn(out, F.col("__off") + F.col("__loc") - F.col("__first"))
            .drop("__mid", "__pid", "__loc", "__off", "__first"))


def quantile_splits(df: DataFrame, col: str, nbuckets: int) -> list:
    """Strictly increasing split points (with -inf/+inf ends) cutting ``col``
    into about ``nbuckets`` equal-count buckets. Only ``nbuckets`` numbers
    reach the driver."""
    probs = [i / nbuckets for i in range(1, nbuckets)]
    qs = df.approxQuantile(col, probs, 0.25 / nbuckets) if probs else []  # finer than the buckets, however many
    inner = sorted({float(q) for q in qs if q is not None and not math.isnan(q)})
    return [-math.inf] + (inner or [0.0]) + [math.inf]


def prefix_sums(df: DataFrame, group_cols: list, score: str, sum_cols: list,
                descending: bool = True, nbuckets: int | None = None,
                suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` per ``group_cols`` in ``score``
    order. ``df`` must have one row per distinct (group, score)."""
    from pyspark.ml.feature import Bucketizer

    nb = nbuckets or max(_nparts(df, None) * 4, 4)
    splits = quantile_splits(df, score, nb)
    bucketed = Bucketizer(splits=splits, inputCol=score, outputCol="__bkt",
                          handleInvalid="keep").transform(df)
    bucketed = bucketed.withColumn("__bkt", F.col("__bkt").cast("int"))
    sc = F.col(score).desc() if descending else F.col(score).asc()
    bk = F.col("__bkt").desc() if descending else F.col("__bkt").asc()
    w_loc = (Window.partitionBy(*group_cols, "__bkt").orderBy(sc)
             .rowsBetween(Window.unboundedPreceding, 0))
    local = bucketed.select("*", *[F.sum(c).over(w_loc).alias(c + "__loc") for c in sum_cols])
    tot = bucketed.groupBy(*group_cols, "__bkt").agg(*[F.sum(c).alias(c + "__tot") for c in sum_cols])
    w_b = (Window.partitionBy(*group_cols).orderBy(bk) if group_cols else Window.orderBy(bk)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*group_cols, "__bkt", *[
        F.coalesce(F.sum(c + "__tot").over(w_b), F.lit(0)).alias(c + "__off") for c in sum_cols])
    res = join_small(local, offs, [*group_cols, "__bkt"])
    return (res.select("*", *[(F.col(c + "__loc") + F.col(c + "__off")).alias(c + suffix)
                              for c in sum_cols])
            .drop("__bkt", *[c + "__loc" for c in sum_cols], *[c + "__off" for c in sum_cols]))


def unpivot(df: DataFrame, id_cols: list, value_cols: list, name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide -> long with ``stack`` (one Generate node, no shuffle)."""
    if not value_cols:
        raise ValueError("no value columns")
    return df.unpivot(id_cols, value_cols, name, value) if id_cols else \
        df.select(F.lit(0).alias("__id"), *value_cols).unpivot(["__id"], value_cols, name, value).drop("__id")


def quantiles_by(long: DataFrame, group_cols: list, value: str, probs: list,
                 nparts: int | None = None) -> DataFrame:
    """One row per group: ``q{i}`` = linear-interpolated quantile
    ``probs[i]`` of the non-NULL ``value``s (DuckDB ``quantile_cont``,
    numpy's default).

    Equal values of a group are counted first (map-side), so a value that most
    rows share is one row. The distinct values are range-partitioned by
    (group, value) and written once; the counts per (partition, group), of
    which there are at most partitions + groups, tell which partitions hold
    the two neighbouring ranks of each quantile. Only those partitions' values
    get running counts."""
    from ..session import ensure_checkpoint_dir
    spark = long.sparkSession
    ensure_checkpoint_dir(spark)
    counted = (long.select(*group_cols, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
               .groupBy(*group_cols, "__v").agg(F.count(F.lit(1)).alias("__c")))
    ranged = counted.repartitionByRange(_nparts(long, nparts), *group_cols, "__v") \
        .withColumn("__pid", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy(*group_cols)
    pos = [(F.col("__n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in pos for f in (F.floor, F.ceil)]))
    held = (ranged.groupBy("__pid", *group_cols).agg(F.sum("__c").alias("__cnt"))
            .select("__pid", *group_cols, "__cnt", F.sum("__cnt").over(w).alias("__n"),
                    (F.sum("__cnt").over(w.orderBy("__pid")) - F.col("__cnt")).alias("__off"))
            .select("__pid", *group_cols, "__n", "__off",
                    F.filter(ranks, lambda r: (r >= F.col("__off")) & (r < F.col("__off") + F.col("__cnt"))).alias("__ranks"))
            .filter(F.size("__ranks") > 0))
    local = join_small(ranged, held, ["__pid", *group_cols])
    upto = F.col("__off") + F.sum("__c").over(Window.partitionBy("__pid", *group_cols).orderBy("__v"))
    found = local.withColumn("__to", upto).withColumn("__ranks", F.filter(
        "__ranks", lambda r: (r < F.col("__to")) & (r >= F.col("__to") - F.col("__c")))).filter(F.size("__ranks") > 0)
    picks = found.groupBy(*group_cols).agg(
        F.first("__n").alias("__n"),
        F.map_from_entries(F.flatten(F.collect_list(F.transform("__ranks", lambda r: F.struct(r, F.col("__v")))))).alias("__at"))
    out = []
    for i, x in enumerate(pos):
        low, high = (F.col("__at")[f(x).cast("long")] for f in (F.floor, F.ceil))
        share = x - F.floor(x)
        out.append((low * (F.lit(1.0) - share) + high * share).alias(f"q{i}"))
    return picks.select(*group_cols, *out)


def narrowed_quantiles(long: DataFrame, group: str, value: str, probs: list, bounds: DataFrame) -> DataFrame:
    """``quantiles_by`` where a guess is known: ``bounds`` has one row per group with ``n`` (its
    non-NULL values) and, for each quantile, ``low{i}`` and ``high{i}`` between which it should lie.

    Values below ``low{i}`` are only counted; the values inside are counted one by one, so few rows
    are shuffled. The counts tell whether both neighbouring ranks were inside; the quantiles of a
    group where one was not come from ``quantiles_by``, so the result is exact whatever the guess."""
    v, some = F.col(value).cast("double"), range(len(probs))
    inside = lambda c, i: (c >= F.col(f"low{i}")) & (c <= F.col(f"high{i}"))
    key = reduce(lambda w, i: w.when(inside(v, i), v), some[1:], F.when(inside(v, 0), v))
    below = [F.sum(F.when(v < F.col(f"low{i}"), 1).otherwise(0)).alias(f"b{i}") for i in some]
    few = long.where(v.isNotNull()).join(F.broadcast(bounds), group).groupBy(group, key.alias("v")) \
        .agg(F.count(F.lit(1)).alias("c"), *below).join(F.broadcast(bounds), group)
    own = lambda i: F.coalesce(inside(F.col("v"), i), F.lit(False))
    counted = few.select(group, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(own(i), F.col("v")).alias("v"), F.when(own(i), F.col("c")).otherwise(F.col(f"b{i}")).alias("c"))
        for i in some])).alias("x")).groupBy(group, "x.i", "x.v").agg(F.sum("x.c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group, "i").orderBy(F.col("v").asc_nulls_first()))
    pos = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("n") - 1).cast("double")
    cum = counted.withColumn("upto", upto).join(F.broadcast(bounds.select(group, "n")), group) \
        .where("v is not null").withColumn("pos", pos)
    at = lambda f: F.max(F.when((f("pos").cast("long") < F.col("upto"))
                                & (f("pos").cast("long") >= F.col("upto") - F.col("c")), F.col("v")))
    found = cum.groupBy(group, "i", "pos").agg(at(F.floor).alias("low"), at(F.ceil).alias("high"))
    share = F.col("pos") - F.floor("pos")
    # n groups x quantiles numbers
    got = {(r[0], r[1]): r[2] for r in found.where("low is not null and high is not null").select(
        group, "i", F.col("low") * (F.lit(1.0) - share) + F.col("high") * share).collect()}
    groups = [r[0] for r in bounds.where("n > 0").select(group).collect()]
    missed = [g for g in groups if any((g, i) not in got for i in range(len(probs)))]
    names = [f"q{i}" for i in range(len(probs))]
    out = long.sparkSession.createDataFrame(
        [(g, *[got[g, i] for i in range(len(probs))]) for g in groups if g not in missed],
        f"{group} {dict(long.dtypes)[group]}, " + ", ".join(f"{q} double" for q in names))
    if missed:
        out = out.unionByName(quantiles_by(long.where(F.col(group).isin(missed)), [group], value, probs))
    return out


def exact_quantiles(df: DataFrame, cols: list, probs: list, nparts: int | None = None) -> DataFrame:
    """One row per column: ``feature`` plus ``q{i}`` = linear-interpolated
    quantile ``probs[i]`` over the column's non-NULL values; columns with no
    values get NULL."""
    spark = df.sparkSession
    long = unpivot(df.select(*cols), [], cols)
    wide = quantiles_by(long, ["feature"], "value", probs, nparts=nparts)
    names = spark.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(wide, "feature", "left")


def with_neighbours(df: DataFrame, group_cols: list, order: str, cols: list, k: int) -> DataFrame:
    """Add ``before`` and ``after``: the up to ``k`` rows of the group before and after each row in
    ``order`` (unique in a group), as arrays of structs of ``cols``, in ascending order.

    Rows are range-partitioned by (group, order), so a large group lies in many partitions. The
    first and last k rows of a group in every partition, at most 2k each, are ordered by
    themselves; what precedes a partition's first and follows its last row there is its halo, and
    windows run inside the partitions over rows and halo."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(_nparts(df, None), *group_cols, order).withColumn("__pid", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("__pid", *group_cols)
    row = F.struct(*ranged.columns)
    edges = ranged.withColumns({"__up": F.row_number().over(here.orderBy(order)), "__down": F.row_number().over(here.orderBy(F.desc(order)))}) \
        .where((F.col("__up") <= k) | (F.col("__down") <= k))
    over = Window.partitionBy(*group_cols).orderBy(order)
    edges = edges.select("__pid", "__up", "__down", F.collect_list(row).over(over.rowsBetween(-k, -1)).alias("__prev"),
                         F.collect_list(row).over(over.rowsBetween(1, k)).alias("__next"))
    halo = edges.where("__up = 1").select("__pid", F.explode("__prev").alias("r")) \
        .unionByName(edges.where("__down = 1").select("__pid", F.explode("__next").alias("r")))
    halo = halo.select("__pid", *[F.col("r")[c].alias(c) for c in df.columns], F.lit(True).alias("__halo"))
    both = ranged.withColumn("__halo", F.lit(False)).unionByName(halo)
    near = here.orderBy(order)
    return both.withColumns({"before": F.collect_list(F.struct(*cols)).over(near.rowsBetween(-k, -1)),
                             "after": F.collect_list(F.struct(*cols)).over(near.rowsBetween(1, k))}) \
        .where("not __halo").drop("__halo", "__pid")
