"""SimHash near-duplicates through covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles. With radius r the bits
are spread over the 2^(r+1)-1 non-zero vectors of r+1 bits; table v keeps the
bits whose vector has an odd inner product with v. The vectors of any r
differing bits leave some non-zero v orthogonal to all of them, and that
table ignores exactly those bits: every pair within the radius meets in some
table, none is missed (Pagh's covering construction).

Scale: equal fingerprints are one class before any comparing, so copies cost
nothing. A bucket is compared block by block against the rows not yet
reached and yields a spanning forest (at most one edge per member), never its
pairs. Buckets with over ``dense`` fingerprints go to a second round which
splits the ignored bits into r+1 segments: a pair within r bits agrees in at
least one. No bucket is capped.

Cases: a NULL or empty text has fingerprint 0 and links like any other; rows
that share a doc_id are one document with several fingerprints' links; a NULL
doc_id gets its component's smallest id, NULL if there is none. An empty
table gives no rows. Only ``doc_id``, ``text`` and the columns
named in ``carry`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, salted_join, stored

BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash over XXH64 (seed 42) of word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((digest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        part = h[i:i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, fp)`` and the columns of ``carry``: fp is the fingerprint as a signed long."""
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *carry])
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "text", *carry).mapInArrow(run, f"doc_id {kinds['doc_id']}, fp long" + "".join(f", {c} {kinds[c]}" for c in carry))


def covering_masks(radius: int) -> list[int]:
    """Kept bits (as unsigned masks) of each of the 2^(radius+1)-1 tables."""
    n = (1 << radius + 1) - 1
    vector = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def segments(mask: int, radius: int) -> list[int]:
    """The bits that ``mask`` ignores, dealt to radius+1 masks; each is joined with ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[s::radius + 1]) for s in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def forest(fps: np.ndarray, radius: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) that join what links within ``radius`` bits joins; at most ``cells`` distances at once."""
    roots, members = [], []
    rest = fps
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            step = max(1, cells // len(rest))
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), step):
                near |= (np.bitwise_count(front[i:i + step, None] ^ rest[None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            roots.append(np.full(len(front), root))
            members.append(front)
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return cat(roots), cat(members)


EDGES = "a long, b long, tab int"


def _link(radius: int, dense: int | None):
    """Task function over rows (tab, key, fp) sorted by (tab, key): edges (a, b, NULL), or
    members of a bucket with over ``dense`` fingerprints as (fp, NULL, tab)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def later(tab: int, parts: list[np.ndarray]):
            fps = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(fps.astype(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), tab, np.int32))],
                ["a", "b", "tab"])

        def close(tab: int, parts: list[np.ndarray], size: int):
            if size < 2 or not parts:
                return None
            if dense and size > dense:
                return later(tab, parts)
            a, b = forest(np.concatenate(parts), radius)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.nulls(len(a), pa.int32())],
                ["a", "b", "tab"]) if len(a) else None

        last, parts, size = None, [], 0
        for batch in batches:
            tab, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().astype(np.uint64)
            if not len(fp):
                continue
            starts = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            lone = ends - starts == 1
            for k in range(len(starts)):
                s, here = starts[k], None
                first, final = k == 0, k == len(starts) - 1
                if lone[k] and not first and not final:
                    continue
                here = (int(tab[s]), int(key[s]))
                if here != last:
                    if last is not None and (out := close(last[0], parts, size)) is not None:
                        yield out
                    last, parts, size = here, [], 0
                parts.append(fp[s:ends[k]])
                size += ends[k] - s
                if dense and size > dense:  # a large bucket is passed on as it comes, not gathered
                    yield later(here[0], parts)
                    parts = []
        if last is not None and (out := close(last[0], parts, size)) is not None:
            yield out
    return run


def links(fps: DataFrame, radius: int = 2, dense: int = 20000) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``."""
    n = partitions(fps.sparkSession)
    masks = covering_masks(radius)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "tab", "key").sortWithinPartitions("tab", "key")

    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                                 for t, m in enumerate(masks)])).alias("x")
    first = stored(dealt(fps.select("fp", tables).select("x.tab", "x.key", "fp"))
                   .mapInArrow(_link(radius, dense), EDGES), "simhash-links")
    second = []
    for t, m in enumerate(masks):
        segs = F.explode(F.array(*[F.struct(F.lit(t * (radius + 1) + s).alias("tab"),
                                            F.col("a").bitwiseAND(F.lit(signed(g))).alias("key"))
                                   for s, g in enumerate(segments(m, radius))])).alias("x")
        second.append(first.where(F.col("tab") == t).select("a", segs).select("x.tab", "x.key", F.col("a").alias("fp")))
    edges = first.where("tab is null").select("a", "b")
    if not first.where("tab is not null").isEmpty():
        rows = second[0]
        for s in second[1:]:
            rows = rows.unionByName(s)
        edges = edges.unionByName(dealt(rows).mapInArrow(_link(radius, None), EDGES).select("a", "b"))
    return edges


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable by links), kept (is it that document; all rows
    stay where a component has no id at all), and the columns of ``carry``."""
    fp = stored(fingerprints(docs, shingle, carry), "simhash-fp")
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(links(classes.select("fp"), radius), "simhash")
    # written once: two joins read it, and each would run the whole chain of rounds
    grouped = stored(classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                     .withColumn("root", F.coalesce("root", "fp")), "simhash-classes")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = salted_join(grouped.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    return salted_join(fp, known, "fp", "doc_id").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
        *(carry or []))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, 2 bits."""
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, radius=2)
