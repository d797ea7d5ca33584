"""Near-duplicate vectors by cross-polytope hashing.

Vectors are turned by pseudo-random rotations (three rounds of random signs
and a fast Hadamard transform); a rotation's hash is the axis, with sign, that
lies nearest. A table joins ``rotations`` such hashes to a bucket; each
vector also enters the buckets it would have had with its least certain axes
replaced by the runner-up (multiprobe). Vectors that share a bucket, and
label, are compared by cosine in double precision, so that every link found is
exact; a link that several buckets find counts in the first alone.

Scale: equal vectors are one class before any comparing. Buckets are first
counted as bare numbers; a vector moves once by its key, and then into the
buckets that it shares with another, as floats where the input has floats. A
bucket is compared in blocks with matrix products and yields, per member, a
link count and at most one edge, never its pairs. Buckets of over ``dense``
vectors are dealt out to tasks by pairs of parts in a second round: exact, no
cap. Joins on components and copies are salted.

Cases: a vector that is NULL, zero, or has NULL or non-finite components, or
whose label is NULL, links with nothing and is its own component; vectors of
different length do not link; rows that share a vec_id are vectors of their
own; a NULL vec_id takes part, but its component's id is the smallest known
one (NULL if there is none). An empty table gives no rows. Only vec_id,
embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, salted_join, stored

TABLES, ROTATIONS, PROBES = 8, 3, 3
SALTS = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(unit: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) buckets of unit vectors; the first is the vector's own."""
    n, d = unit.shape
    wide = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, wide))
    x[:, :d] = unit
    signs = np.random.default_rng(wide).choice([-1.0, 1.0], (tables, rotations, 3, wide))
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        own, second, gap = (np.zeros((n, rotations), kind) for kind in (np.int64, np.int64, float))
        for r in range(rotations):
            y = x
            for s in range(3):
                y = hadamard(y * signs[t, r, s])
            both = np.concatenate((y, -y), axis=1)
            top = np.argpartition(-both, 1, axis=1)[:, :2] if wide > 1 else np.argsort(-both, axis=1)[:, :2]
            value = np.take_along_axis(both, top, axis=1)
            turn = value[:, 1] > value[:, 0]
            top[turn], value[turn] = top[turn][:, ::-1], value[turn][:, ::-1]
            own[:, r], second[:, r], gap[:, r] = top[:, 0], top[:, 1], value[:, 0] - value[:, 1]
        place = (2 * wide) ** np.arange(rotations)
        out[:, t, 0] = own @ place
        order = np.argsort(gap, axis=1)
        for p in range(probes):  # of the 2^rotations - 1 replacements: the least certain axis, the next, both ...
            axes = [order[:, p]] if p < rotations else [order[:, k] for k in range(rotations)]
            probe = own.copy()
            for a in axes:
                probe[np.arange(n), a] = second[np.arange(n), a]
            out[:, t, 1 + p] = probe @ place
    return out


def unit_rows(binary: pa.Array, length: int) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in binary.to_pylist()]).reshape(-1, length)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable (label, vector): key, label, embedding, first_id, copies; plus the rows with their key."""
    good = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & \
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & \
        F.exists("embedding", lambda v: v != 0)
    # 0.0 + v: one zero, whatever its sign
    exact = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    key = F.when(F.coalesce(good, F.lit(False)), F.substring(F.sha2(F.concat_ws(
        ":", F.col("label").cast("string"), F.array_join(F.transform(exact, lambda v: v.cast("string")), ",")), 256), 1, 32))
    kind = dict(vectors.dtypes)["embedding"]
    kept = exact.cast("array<float>") if kind == "array<float>" else exact  # floats are doubles without loss, and back
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(key.isNotNull(), kept).alias("embedding"),
                          key.alias("key"))


def hashed(reps: DataFrame, tables: int, rotations: int, probes: int) -> DataFrame:
    """Each class with its buckets: key, buckets (a 64-bit number for every table and probe; equal ones have equal
    table, code, vector length and label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_length: dict[int, list[int]] = {}
            rows = [np.array(v, np.float64) for v in b.column(2).to_pylist()]
            for i, v in enumerate(rows):
                by_length.setdefault(len(v), []).append(i)
            label = b.column(1).to_pylist()
            out = np.zeros((len(rows), tables, 1 + probes), np.int64)
            for length, at in by_length.items():
                for k in range(0, len(at), 2048):
                    some = at[k:k + 2048]
                    c = codes(unit(np.stack([rows[i] for i in some])), tables, rotations, probes)
                    names = np.array([xxhash.xxh64_intdigest(f"{length}/{label[i]}".encode()) for i in some], np.uint64)
                    out[some] = scrambled(c, names)
            flat = out.reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))], ["key", "buckets"])
    return reps.select("key", "label", "embedding").mapInArrow(run, "key string, buckets array<long>")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scrambled(c: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Codes (rows, tables, probes) as 64-bit numbers that also hold the table and the row's name."""
    x = c.astype(np.uint64) * np.uint64(c.shape[1]) + np.arange(c.shape[1], dtype=np.uint64)[None, :, None]
    x = (x ^ names[:, None, None]) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def bucket_rows(reps: DataFrame, tables: int, rotations: int, probes: int) -> DataFrame:
    """Each class once per bucket that it shares with another class: bucket, key, copies, vec, shared (its shared buckets).

    Buckets are counted as bare numbers; a vector is fetched once, by its key, and copied only into buckets where it has
    company. Floats travel as floats."""
    of = stored(hashed(reps, tables, rotations, probes), "vectors-buckets")
    each = of.select("key", F.explode(F.array_distinct("buckets")).alias("bucket"))
    company = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    # a bucket of many is dealt to several tasks
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    spread = company.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = each.withColumn("salt", salt).join(spread, ["bucket", "salt"]).groupBy("key").agg(F.array_sort(F.collect_list("bucket")).alias("shared"))
    return reps.select("key", "copies", "embedding").join(met, "key") \
        .select(F.explode("shared").alias("bucket"), "key", "copies", F.col("embedding").alias("vec"), "shared")


class Bucket:
    """Vectors of one bucket, and their comparison."""

    def __init__(self, bucket: int, rows: list[tuple], cosine: float) -> None:
        self.bucket = bucket
        self.keys = [r[0] for r in rows]
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.unit = unit(np.array([r[2] for r in rows], np.float64))
        # the shared buckets smaller than this one, as rows of equal width
        smaller = [[x for x in r[3] if x < bucket] for r in rows]
        width = max(map(len, smaller))
        self.smaller = np.array([x + [bucket] * (width - len(x)) for x in smaller], np.int64).reshape(len(rows), width)
        self.side = np.array([r[4] if len(r) > 4 else 0 for r in rows])
        self.cosine = cosine

    def first_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows that meet here: do they meet in no bucket of a smaller number?"""
        x, y = self.smaller[a], self.smaller[b]
        return ~((x[:, :, None] == y[:, None, :]) & (x < self.bucket)[:, :, None]).any(axis=(1, 2))

    def compare(self, across: bool, block: int = 1024) -> tuple[np.ndarray, list[tuple[str, str]]]:
        """Copies linked to each row, and edges that join what the links join. ``across``: only pairs of different sides."""
        n = len(self.keys)
        linked, root = np.zeros(n, np.int64), np.arange(n)
        for i in range(0, n, block):
            for j in range(i, n, block):
                near = self.unit[i:i + block] @ self.unit[j:j + block].T >= self.cosine
                if i == j:
                    near = np.triu(near, 1)
                if across:
                    near &= self.side[i:i + block, None] != self.side[None, j:j + block]
                a, b = np.nonzero(near)
                a, b = a + i, b + j
                for k in range(0, len(a), 1 << 16):
                    x, y = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
                    new = self.first_here(x, y)
                    x, y = x[new], y[new]
                    np.add.at(linked, x, self.copies[y])
                    np.add.at(linked, y, self.copies[x])
                    while True:  # join the roots of linked rows
                        rx, ry = root[x], root[y]
                        if (rx == ry).all():
                            break
                        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
                        while (root[root] != root).any():
                            root = root[root]
        edges = [(self.keys[k], self.keys[r]) for k, r in enumerate(root) if k != r]
        return linked, edges


def _found(vec: str) -> str:
    return f"a string, b string, links long, bucket long, copies long, vec {vec}, shared array<long>"


def _compared(cosine: float, vec: pa.DataType, dense: int | None):
    """Task function over rows sorted by their bucket: (a, NULL, links) counts, (a, b) edges, and the rows of
    buckets with ``dense`` of them or more, to be dealt out again."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("links", pa.int64()), ("bucket", pa.int64()), ("copies", pa.int64()),
                        ("vec", pa.list_(vec)), ("shared", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: tuple, rows: list[tuple]):
            if len(rows) < 2:
                return
            own = Bucket(at[0], rows, cosine)
            linked, edges = own.compare(across=len(at) > 1 and at[1] != at[2])
            out = [{"a": own.keys[k], "links": int(linked[k])} for k in np.flatnonzero(linked)]
            out += [{"a": a, "b": b} for a, b in edges]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

        def later(at: tuple, rows: list[tuple]):
            return pa.RecordBatch.from_pylist([{"a": r[0], "bucket": at[0], "copies": r[1], "vec": r[2], "shared": r[3]} for r in rows], schema)

        last, rows, large = None, [], False
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for r in zip(*cols, strict=True):
                at = (r[0], *r[5:7])
                if at != last:
                    if large and rows:
                        yield later(last, rows)
                    elif last is not None:
                        yield from close(last, rows)
                    last, rows, large = at, [], False
                rows.append(r[1:5] + r[7:])
                if dense and len(rows) >= dense:  # a large bucket is passed on as it comes, not gathered
                    yield later(at, rows)
                    rows, large = [], True
        if large and rows:
            yield later(last, rows)
        elif last is not None:
            yield from close(last, rows)
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, rotations: int = ROTATIONS,
                 probes: int = PROBES, dense: int = 8192) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept."""
    n = partitions(vectors.sparkSession)
    rows = stored(classes(vectors), "vectors-rows")
    reps = stored(rows.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "vectors-classes")
    kind = dict(reps.dtypes)["embedding"]
    vec = pa.float32() if kind == "array<float>" else pa.float64()
    found = stored(bucket_rows(reps, tables, rotations, probes).repartition(n, "bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_compared(cosine, vec, dense), _found(kind)), "vectors-found")
    plain = found.where("bucket is null")
    again = found.where("bucket is not null")
    if not again.isEmpty():
        part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
        size = again.groupBy("bucket").agg(F.ceil(2 * F.count(F.lit(1)) / dense).cast("int").alias("parts"))
        dealt = again.join(size, "bucket").withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
            .select("bucket", F.col("a").alias("key"), "copies", "vec", "shared",
                    F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")
        keys = ["bucket", "p", "q"]
        plain = stored(plain.unionByName(dealt.repartition(n, *keys).sortWithinPartitions(*keys)
                                         .mapInArrow(_compared(cosine, vec, None), _found(kind))), "vectors-again")
    counts = plain.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    comp = components(plain.where("b is not null").select("a", "b"), "vectors")
    known = reps.select("key", "first_id", "copies") \
        .join(counts.withColumnRenamed("a", "key"), "key", "left") \
        .join(comp.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("first_id").alias("least_id"))
    known = salted_join(known, least, "root", "key").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "least_id")
    out = salted_join(rows.select("vec_id", "key"), known, "key", "vec_id", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, cosine 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
