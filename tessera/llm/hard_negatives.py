"""Hard negatives by exact inner products over Kronecker-packed candidates.

Components become integers (``floor(256 * x)``). Several candidates' values of
one component, made non-negative by a bias, stand side by side in fields of
one wide integer; multiplying it by an anchor's (biased) component multiplies
all of them at once, and the sum over the components holds one inner product
per field. A field is as wide as the largest sum can be, so no field ever
carries into the next; the biases are taken off after unpacking and every
score is exact. Up to 52 bits the wide integer is held in a double (exact up
to 2^53), so that the multiply-add runs as a matrix product; wider ones are
Python integers of any length, with whole bytes per field.

Two passes: an anchor's positives are its best rows of the same label; its
negatives follow from their scores, as the best rows of other labels whose
score lies between two shares of the positive's.

Scale: anchors are a stated query set, compared with all rows. They are
written once in blocks of bounded bytes; a job takes a bounded number of
blocks to every task, and the candidates are read where they lie, packed chunk
by chunk, and never shuffled. A task keeps its best few rows per anchor, the
only rows that move. Labels play no part in dealing out the work, so that a
hot label or a group of copies lies in no single task.

Cases: rows with a NULL label, a NULL vector, or a NULL or non-finite
component take no part; vectors of different length have no inner product and
are no candidates for each other; rows that share a vec_id are rows of their
own; a NULL vec_id is never an anchor and comes after all others among equal
scores. A score outside the range of a long is compared exactly and returned
as NULL. An empty table gives no rows. Only vec_id, embedding and label are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_BYTES = 1 << 21  # of anchors' components in a block
JOB_BLOCKS = 8  # blocks that one job takes to every task
CHUNK = 2048  # candidates packed at once
WIDE = 52  # bits of a wide integer that a double holds, signs and all
NO_ID = np.iinfo(np.int64).max
LONG = pa.int64()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and components as doubles of the rows that take part; labels of ids divisible by 7 turned to the next of ten."""
    v, c = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(v % 7 == 0, F.pmod(c + 1, F.lit(10))).otherwise(c)
    ok = c.isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(
        v.alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def integers(x: np.ndarray, factor: int = 256) -> np.ndarray:
    """``floor(factor * x)`` as int64, or as Python integers where those do not hold them or a product would not fit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(factor))
    if not y.size or np.abs(y).max() < 2.0 ** 30:
        return y.astype(np.int64)
    exact = [int(v) if np.isfinite(v) else int(u) * factor for v, u in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


class Packed:
    """Candidates (rows of integers) packed for anchors whose components lie between ``low`` and ``high``."""

    def __init__(self, rows: np.ndarray, low: int, high: int) -> None:
        self.n, self.d = rows.shape
        self.bias = -int(rows.min()) if rows.size else 0
        self.anchor_bias = -low
        top = int(rows.max()) + self.bias if rows.size else 0
        # no sum of a field, and no bias to be taken off, is larger
        self.width = max(1, max(high - low, abs(low)) * max(top, abs(self.bias)) * self.d).bit_length()
        self.fields = WIDE // self.width
        self.double = self.fields > 0
        rows = rows if self.double else rows.astype(object)
        lifted = rows + self.bias
        self.sums = rows.sum(axis=1)
        if self.double:
            groups = -(-self.n // self.fields)
            padded = np.zeros((groups * self.fields, self.d))
            padded[:self.n] = lifted
            place = 2.0 ** (self.width * np.arange(self.fields))
            self.wide = np.einsum("gfd,f->dg", padded.reshape(groups, self.fields, self.d), place)
        else:
            self.bytes = -(-self.width // 8)
            self.wide = [int.from_bytes(b"".join(int(v).to_bytes(self.bytes, "little") for v in column), "little")
                         for column in lifted.T]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, candidates) inner products, exact."""
        lifted = (anchors if self.double else anchors.astype(object)) + self.anchor_bias
        if self.double:
            total = (lifted.astype(np.float64) @ self.wide).astype(np.int64)
            mask = (1 << self.width) - 1
            fields = np.stack([total >> self.width * f & mask for f in range(self.fields)], axis=-1)
            raw = fields.reshape(len(anchors), fields.shape[1] * self.fields)[:, :self.n]
        else:
            raw = np.empty((len(anchors), self.n), object)
            for i, row in enumerate(lifted.tolist()):
                total = sum(int(a) * w for a, w in zip(row, self.wide, strict=True)).to_bytes(self.bytes * self.n + 8, "little")
                raw[i] = [int.from_bytes(total[k:k + self.bytes], "little") for k in range(0, self.bytes * self.n, self.bytes)]
        # (a + A)(c + C) = ac + C(a + A) + A c, summed
        off = self.bias * lifted.sum(axis=1)
        return raw - off[:, None] - self.anchor_bias * self.sums[None, :]


class Best:
    """The first ``k`` rows of each of ``n`` lists, by score downwards, then vec_id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.rows = (np.empty(0, np.int64), np.empty(0, object), np.empty(0, np.int64))
        self.last = np.full(n, None, object)  # score of the k-th row once there are k

    def floor(self, scores: np.ndarray) -> np.ndarray:
        """A score per list below which nothing can enter any more."""
        least = np.iinfo(np.int64).min if scores.dtype != object else -(1 << 4096)
        return np.array([least if v is None else v for v in self.last], scores.dtype)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        li, sc, vid = (np.concatenate((a, b)) for a, b in zip(self.rows, (lists, scores, ids), strict=True))
        if sc.dtype == object and all(abs(s) < 1 << 62 for s in sc.tolist()):
            sc = sc.astype(np.int64)
        order = np.lexsort((vid, -sc, li)) if sc.dtype != object else np.array(
            sorted(range(len(sc)), key=lambda i: (li[i], -sc[i], vid[i])), np.int64)
        li, sc, vid = li[order], sc[order], vid[order]
        first = np.flatnonzero(np.concatenate(([True], li[1:] != li[:-1])))
        rank = np.arange(len(li)) - np.repeat(first, np.diff(np.append(first, len(li))))
        keep = rank < self.k
        full = rank == self.k - 1
        self.last[li[full]] = sc[full].astype(object)
        self.rows = li[keep], sc[keep], vid[keep]


def anchor_blocks(anchors: DataFrame, block_bytes: int) -> DataFrame:
    """Anchors in blocks of one vector length: block, length, ids, labels, vectors (doubles), as joined bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}

        def flush(length: int):
            nonlocal no
            rows = held.pop(length)
            out = {"block": [task << 32 | no], "length": [length], "ids": [np.array([r[0] for r in rows], np.int64).tobytes()],
                   "labels": [np.array([r[1] for r in rows], np.int64).tobytes()], "vectors": [b"".join(r[2] for r in rows)]}
            no += 1
            return pa.RecordBatch.from_pydict(out, pa.schema([("block", LONG), ("length", pa.int32()), ("ids", pa.binary()),
                                                              ("labels", pa.binary()), ("vectors", pa.binary())]))
        for b in batches:
            for vid, label, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = held.setdefault(len(x), [])
                rows.append((vid, label, np.array(x, np.float64).tobytes()))
                if len(rows) * max(16, 8 * len(x)) >= block_bytes:
                    yield flush(len(x))
        for length in list(held):
            yield flush(length)
    return anchors.select("vec_id", "label", "x").mapInArrow(run, "block long, length int, ids binary, labels binary, vectors binary")


def _chunks(batches: Iterator[pa.RecordBatch], lengths: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of the given vector lengths, up to CHUNK of one length at once: ids, labels, integers."""
    for b in batches:
        x = b.column(2)
        sizes = np.diff(x.offsets.to_numpy())
        ids = b.column(0).fill_null(NO_ID).to_numpy()
        labels = b.column(1).to_numpy()
        flat = x.flatten().to_numpy()
        begin = np.cumsum(sizes) - sizes
        for length in lengths & set(sizes.tolist()):
            rows = np.flatnonzero(sizes == length)
            for k in range(0, len(rows), CHUNK):
                r = rows[k:k + CHUNK]
                yield ids[r], labels[r], integers(flat[begin[r][:, None] + np.arange(length)])


def _found(kind: str, k: int, low: int, high: int, anchors: list[dict]):
    """Task function over candidates (vec_id, label, x): the task's best rows per list.

    ``kind`` 'same': lists are anchors, rows of their label. 'other': lists are (anchor, positive), rows of other labels
    with low * positive <= 100 * score <= high * positive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for a in anchors:
            ids = np.frombuffer(a["ids"], np.int64)
            x = integers(np.frombuffer(a["vectors"], np.float64).reshape(len(ids), a["length"]))
            lists = np.arange(len(ids)) if kind == "same" else None
            blocks.append({**a, "x": x, "own": np.frombuffer(a["labels"], np.int64),
                           "best": Best(len(ids) if kind == "same" else len(a["scores"]), k), "lists": lists})
        for ids, labels, rows in _chunks(batches, {a["length"] for a in anchors}):
            todo = [a for a in blocks if a["length"] == rows.shape[1]]
            bounds = [(int(a["x"].min()), int(a["x"].max())) for a in todo if a["x"].size]
            packed = Packed(rows, min((v for v, _ in bounds), default=0), max((v for _, v in bounds), default=0))
            for a in todo:
                step = max(1, (1 << 21) // max(1, len(ids)))
                same = a["own"][:, None] == labels[None, :]
                for i in range(0, len(a["x"]), step):
                    score = packed.scores(a["x"][i:i + step])
                    if kind == "same":
                        at, col = np.nonzero(same[i:i + step] & (score >= a["best"].floor(score)[i:i + step, None]))
                        a["best"].add(at + i, score[at, col], ids[col])
                    else:
                        floor = a["best"].floor(score)
                        for q in range(a["per"]):  # the q-th positive of these anchors
                            lists = a["list"][i:i + step, q]
                            has = np.flatnonzero(lists >= 0)
                            if not len(has):
                                continue
                            p = a["scores"][lists[has]]
                            p = p.astype(score.dtype) if score.dtype == object or p.dtype != object else p
                            s = score[has] if len(has) < len(lists) else score
                            least = np.maximum(-(-low * p // 100), floor[lists[has]])
                            at, col = np.nonzero(~same[i:i + step][has] & (s >= least[:, None]) & (s <= (high * p // 100)[:, None]))
                            a["best"].add(lists[has][at], s[at, col], ids[col])
        for a in blocks:
            li, sc, vid = a["best"].rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(li), a["block"])), pa.array(li), pa.array([str(s) for s in sc.tolist()], pa.string()),
                 pa.array(vid, LONG, mask=vid == NO_ID)], ["block", "list", "score", "vec_id"])
    return run


FOUND = "block long, list long, score string, vec_id long"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each list over all tasks, with their place from 1."""
    # decimals hold every score that two rows are told apart by in practice; wider ones compare by sign, length and digits
    wide = F.length("score") > 18
    sign = F.when(F.startswith(F.col("score"), F.lit("-")), -1).otherwise(1)
    digits = F.ltrim(F.col("score"), F.lit("-"))
    size = F.when(wide, sign * F.length(digits)).otherwise(F.lit(0))
    text = F.when(wide, F.when(sign > 0, digits).otherwise(F.translate(digits, "0123456789", "9876543210")))
    narrow = F.when(~wide, F.col("score").cast("long"))
    level = F.when(wide & (sign > 0), 2).when(wide, 0).otherwise(1)
    w = Window.partitionBy("block", "list").orderBy(level.desc(), size.desc(), text.desc(), narrow.desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per anchor (vec_id divisible by ``every``), positive and negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    blocks = stored(anchor_blocks(rows.where(F.col("vec_id") % every == 0), block_bytes), "anchors")
    numbers = sorted(r[0] for r in blocks.select("block").collect())  # one number per block
    out: list[DataFrame] = []
    for k in range(0, len(numbers), JOB_BLOCKS):
        part = [r.asDict() for r in blocks.where(F.col("block").isin(numbers[k:k + JOB_BLOCKS])).collect()]  # bounded bytes
        found = rows.mapInArrow(_found("same", positives + 1, low, high, part), FOUND)
        best = stored(_first(found, positives + 1), "positives")
        mined = []
        by_block: dict[int, dict[int, list]] = {}
        for r in best.orderBy("block", "list", "place").collect():  # at most positives + 1 rows for each of the part's anchors
            by_block.setdefault(r.block, {}).setdefault(r.list, []).append((int(r.score), r.vec_id))
        for a in part:
            ids = np.frombuffer(a["ids"], np.int64)
            x = integers(np.frombuffer(a["vectors"], np.float64).reshape(len(ids), a["length"]))
            table, scores, names = np.full((len(ids), positives), -1, np.int64), [], []
            for i, vid in enumerate(ids.tolist()):
                got = by_block.get(a["block"], {}).get(i, [])
                own = (sum(int(v) * int(v) for v in x[i].tolist()), vid)  # the anchor itself, or a row that cannot be told from it
                if own in got:
                    got = [g for j, g in enumerate(got) if j != got.index(own)]
                for q, (score, pid) in enumerate(got[:positives]):
                    table[i, q] = len(scores)
                    scores.append(score)
                    names.append((a["block"], len(names), vid, pid, q, str(score)))
            fits = all(abs(s) < 1 << 50 for s in scores)
            a["list"], a["per"] = table, positives
            a["scores"] = np.array(scores, np.int64) if fits else np.array([*scores, None], object)[:-1]
            mined += names
        if not mined:
            continue
        found = rows.mapInArrow(_found("other", negatives, low, high, [a for a in part if len(a["scores"])]), FOUND)
        pairs = spark.createDataFrame(mined, "block long, list long, anchor_id long, positive_id long, q int, positive_score string")
        long = lambda c: F.expr(f"try_cast({c} as bigint)")
        out.append(stored(_first(found, negatives).join(pairs, ["block", "list"]).select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            long("positive_score").alias("positive_score"), long("score").alias("negative_score")), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    done = out[0]
    for o in out[1:]:
        done = done.unionByName(o)
    return done


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors against all vectors: 5 positives, 3 negatives each, 50 to 95 % of the positive's score."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
