"""Helpers that the operators share: stored intermediates, row keys, components.

Intermediates that several jobs read are written once, as Parquet, to the
shared folder named by ``spark.checkpoint.dir``: a lost executor re-reads them
instead of recomputing their whole lineage. The files stay until that folder
is cleaned, like those of ``checkpoint()``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions: the unit in which work is dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in ``text``; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_join(rows: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """``rows`` joined with at most one row of ``one`` per ``key``; the rows of a frequent key are dealt to ``salts`` tasks by ``spread``."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, one per
    node that has an edge to another node; ``root`` is the same node for all
    of a component.

    Every round each node picks, of itself and its neighbours, the one with
    the smallest hash (a new hash each round, so that long chains also shrink
    by a constant share) and the edges are contracted onto the picks, until
    none is left: about log(n) rounds, each two joins and one pre-aggregated
    minimum. Node ids may be of any type that can be ordered and hashed.
    """
    spark = edges.sparkSession
    e = stored(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    picks: list[DataFrame] = []
    seed = 0
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("v"))  # noqa: B023,E731
        best = both.groupBy("a").agg(F.min(h(F.col("b"))).alias("m"))
        pick = stored(best.select(F.col("a").alias("node"), F.least(F.col("m"), h(F.col("a")))["v"].alias("to")),
                      f"{name}-pick")
        picks.append(pick)
        left = pick.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = pick.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        e = stored(e.join(left, "a").join(right, "b").where("a2 <> b2")
                   .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
                   f"{name}-edges")
        seed += 1
    if not picks:
        return spark.createDataFrame([], "node " + dict(edges.dtypes)["a"] + ", root " + dict(edges.dtypes)["a"])
    # a later round holds only nodes that still had edges: the others are their own root
    up = picks[-1].withColumnRenamed("to", "root")
    for pick in reversed(picks[:-1]):
        nxt = up.select(F.col("node").alias("to"), F.col("root"))
        up = pick.join(nxt, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return up
