"""Removal of repeated word windows by prefix-partitioned suffix trees.

A word goes if a window of ``LENGTH`` (35) words that covers it also starts
anywhere else. One suffix tree of the corpus fits no task, so suffixes are
split by prefix. Prefixes are taken at sampled places: each window has a mark,
its 8-word string of the smallest hash (leftmost of equals), which depends on
the window alone. Windows with the same mark that follow one another form a
passage, and the suffixes of one group are the windows of all passages whose
mark, their common prefix at that place, is the same: equal windows always lie
in one group.

1. Passages are hashed in blocks of documents and equal passages of a block
   are counted. Passages that stand in two places or more are repeats as a
   whole: all leaves of their subtree lie below one deep node.
2. Groups with one passage hold no other repeat. The others are built: each
   different passage's words go, once, to their group's task, whose suffixes
   are sorted by doubled prefixes; the common prefixes of neighbours give the
   tree's internal nodes, and the leaves below a node of 35 words or more are
   windows that repeat.
3. Prefixes have variable length: a group of more than ``FAMILY`` different
   passages (one frequent 8-word string with different surroundings) is split
   by the prefix of full depth, 35 words. Such a group is a single node, whose
   leaves need only be counted, so it fits however many there are.

Scale: texts are stored once, compressed and bucketed by block, and the three
passes over them (passages, group words, removal) read them in place. What
moves is one small row per different passage of a block (a passage covers 14
words on average), so thousands of copies are one row per block, and the words
of groups with several passages. A task holds one block, or groups of bounded
size. Words, marks, passages and full prefixes are told apart by 64-bit hashes.

Cases: NULL and empty texts have no words; a document under 35 words loses
none; a document may repeat itself; NULL and repeated doc_ids are documents of
their own, since windows count by place. Texts of any length are handled as a
whole. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder, stored
from .suffix_dedup import block_rows

LENGTH = 35
MARK = 8
MARKS = LENGTH - MARK + 1  # marks to choose from in a window, and windows in a passage at most
BLOCK_BYTES = 1 << 21
SEGMENT = 1 << 15  # words hashed at once; the arrays then stay in a processor's cache
SPLIT_BYTES = 1 << 20
FAMILY = 2048  # different passages in a group that is built as one tree
BATCH_WORDS = 1 << 16  # words of groups that are built together, unless one is larger
WHOLE = -1  # bits of a passage that repeats as a whole

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _C1 + (b ^ b >> np.uint64(31))) * _C2
    return x ^ x >> np.uint64(29)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:span - width], x[width - span:])


def split_words(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, up to about ``SPLIT_BYTES`` of it at once."""
    at = 0
    while at < len(data):
        end = at + SPLIT_BYTES
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    parts = [np.fromiter(map(digest, words), np.uint64, len(words)) for words in split_words(data)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def passages(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of joined documents that end at ``ends``: mark, first and last window of every passage."""
    parts = []
    for seg in range(0, max(0, len(h) - LENGTH + 1), SEGMENT):
        part = h[seg:seg + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        h2 = _mix(part[:-1], part[1:])
        h4 = _mix(h2[:-2], h2[2:])
        mark = _mix(h4[:-4], h4[4:])
        chosen = (_least(mark & _HIGH | np.arange(len(mark), dtype=np.uint64), MARKS) & _LOW).astype(np.int64)
        inside = np.ones(n + 1, bool)  # windows that stand in one document
        for e in ends[(ends > seg) & (ends < seg + n + LENGTH - 1)].tolist():
            inside[max(0, e - seg - LENGTH + 1):min(n, e - seg)] = False
        window = np.flatnonzero(inside[:n])
        if not len(window):
            continue
        at = chosen[window]
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))))
        last = np.concatenate((first[1:], [len(window)])) - 1
        parts.append((mark[at[first]], window[first] + seg, window[last] + seg))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Block:
    """The words of a block of documents, its passages, and its different contents with their numbers of places."""

    def __init__(self, row: dict) -> None:
        self.raw = zstandard.decompress(row["data"]) if row["data"] else b""
        self.bytes = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int64)))).tolist()
        hashes = [word_hashes(self.raw[a:b]) for a, b in zip(self.bytes, self.bytes[1:], strict=False)]
        self.ends = np.cumsum([len(x) for x in hashes])
        self.h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.mark, self.low, self.high = passages(self.h, self.ends)
        view, digest = memoryview(self.h.view(np.uint8)), xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(view[8 * a:8 * b]) for a, b in zip(self.low.tolist(), (self.high + LENGTH).tolist(), strict=True)),
                              np.uint64, len(self.low)).view(np.int64)
        self.content, self.pick, self.group, self.places = np.unique(content, return_index=True, return_inverse=True, return_counts=True)

    def picked(self, content: np.ndarray) -> np.ndarray:
        """A passage for each of the given contents, which all occur."""
        return self.pick[np.searchsorted(self.content, content)]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> their different contents: mark, content, block, places."""
    for b in batches:
        for row in b.to_pylist():
            x = Block(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.mark[x.pick].view(np.int64)), pa.array(x.content), pa.array(np.full(len(x.content), row["block"], np.int64)),
                 pa.array(x.places.astype(np.int64))], ["mark", "content", "block", "places"])


SENT = "mark long, block long, content long, alone boolean, words binary, prefix long, at int"
_SENT = pa.schema([("mark", pa.int64()), ("block", pa.int64()), ("content", pa.int64()), ("alone", pa.bool_()), ("words", pa.binary()),
                   ("prefix", pa.int64()), ("at", pa.int32())])


def _sent(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block and the contents asked of it -> their words, or of contents of large groups the prefix of every window."""
    if not left.num_rows or not right.num_rows:
        return _SENT.empty_table()
    x = Block(left.to_pylist()[0])
    content, alone, large = (right.column(c).to_numpy() for c in ("content", "alone", "large"))
    block = left.column("block")[0].as_py()
    p = x.picked(content)
    out = []
    rows = np.flatnonzero(~large)
    if len(rows):
        words = [x.h[a:b].tobytes() for a, b in zip(x.low[p[rows]].tolist(), (x.high[p[rows]] + LENGTH).tolist(), strict=True)]
        out.append(pa.table({"mark": x.mark[p[rows]].view(np.int64), "block": np.full(len(rows), block, np.int64), "content": content[rows],
                             "alone": alone[rows], "words": pa.array(words, pa.binary()), "prefix": pa.nulls(len(rows), pa.int64()),
                             "at": pa.nulls(len(rows), pa.int32())}, _SENT))
    rows = np.flatnonzero(large)
    if len(rows):
        count = x.high[p[rows]] - x.low[p[rows]] + 1
        owner = np.repeat(rows, count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = (x.low[p[owner]] + at).tolist()
        view, digest = memoryview(x.h.view(np.uint8)), xxhash.xxh3_64_intdigest
        prefix = np.fromiter((digest(view[8 * a:8 * a + 8 * LENGTH]) for a in begin), np.uint64, len(begin)).view(np.int64)
        out.append(pa.table({"mark": x.mark[p[owner]].view(np.int64), "block": np.full(len(owner), block, np.int64), "content": content[owner],
                             "alone": alone[owner], "words": pa.nulls(len(owner), pa.binary()), "prefix": prefix,
                             "at": at.astype(np.int32)}, _SENT))
    return pa.concat_tables(out)


def suffix_tree(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the suffix tree of the strings in order, as (string, offset), and the depth of the node that joins
    each leaf with the one before it."""
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes + 1) - sizes - 1
    names, inverse = np.unique(np.concatenate(strings), return_inverse=True)
    n = int((sizes + 1).sum())
    rank = np.empty(n, np.int64)
    mine = np.ones(n, bool)
    mine[begin + sizes] = False
    rank[mine] = inverse
    rank[~mine] = len(names) + np.arange(len(strings))  # every string ends in a letter of its own
    levels, span = [rank], 1
    while span <= sizes.max():
        pair = rank * (n + 1)
        pair[:-span] += rank[span:] + 1
        _, rank = np.unique(pair, return_inverse=True)
        levels.append(rank)
        span *= 2
    order = np.argsort(rank, kind="stable")
    order = order[mine[order]]
    depth = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 2, -1, -1):
        x, y = np.minimum(a + depth[1:], n - 1), np.minimum(b + depth[1:], n - 1)
        depth[1:] += np.where(levels[k][x] == levels[k][y], 1 << k, 0)
    string = np.repeat(np.arange(len(strings)), sizes + 1)[order]
    return string, order - begin[string], depth


def repeated_windows(strings: list[np.ndarray], length: int = LENGTH) -> np.ndarray:
    """Per string, as bits, which of its windows lie below a node of depth ``length`` or more."""
    string, offset, depth = suffix_tree(strings)
    deep = depth >= length
    below = deep | np.append(deep[1:], False)  # both leaves that a deep node joins
    bits = np.zeros(len(strings), np.int64)
    np.bitwise_or.at(bits, string[below], np.int64(1) << offset[below])
    return bits


PART = pa.schema([("block", pa.int64()), ("content", pa.int64()), ("bits", pa.int64())])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by mark -> the repeated windows of those that stand in one place."""
    held: list[tuple] = []  # whole groups
    group: list[tuple] = []
    size, mark = 0, None

    def close(rows: list[tuple]):
        bits = repeated_windows([np.frombuffer(r[3], np.uint64) for r in rows])
        hit = [(r[0], r[1], int(x)) for r, x in zip(rows, bits.tolist(), strict=True) if x and r[2]]
        return pa.RecordBatch.from_pylist([dict(zip(PART.names, h, strict=True)) for h in hit], PART)

    for b in batches:
        for m, *row in zip(*(b.column(c).to_pylist() for c in ("mark", "block", "content", "alone", "words")), strict=True):
            if m != mark:
                held += group
                group, mark = [], m
                if size >= BATCH_WORDS:
                    yield close(held)
                    held, size = [], 0
            group.append(tuple(row))
            size += len(row[3]) // 8
    if held or group:
        yield close(held + group)


def _removed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block and the repeated windows of its contents -> a row per document."""
    row = left.to_pylist()[0]
    x = Block(row)
    bits = np.zeros(len(x.content), np.int64)
    if right.num_rows:
        np.bitwise_or.at(bits, np.searchsorted(x.content, right.column("content").to_numpy()), right.column("bits").to_numpy())
    of = bits[x.group] if len(bits) else bits
    cover = np.zeros(len(x.h) + 1, np.int32)
    whole = np.flatnonzero(of < 0)
    np.add.at(cover, x.low[whole], 1)
    np.add.at(cover, x.high[whole] + LENGTH, -1)
    some = np.flatnonzero(of > 0)
    for j in range(MARKS):
        hit = some[(of[some] >> j & 1).astype(bool)]
        np.add.at(cover, x.low[hit] + j, 1)
        np.add.at(cover, x.low[hit] + j + LENGTH, -1)
    gone = np.cumsum(cover)[:-1] > 0
    sizes, removed, digests = [], [], []
    begin = 0
    for k, end in enumerate(x.ends.tolist()):
        g = gone[begin:end]
        digest, at, given = hashlib.sha256(), 0, False
        for words in split_words(x.raw[x.bytes[k]:x.bytes[k + 1]]):
            here = g[at:at + len(words)]
            at += len(words)
            if here.any():
                words = [w for w, out in zip(words, here.tolist(), strict=True) if not out]
            if words:
                digest.update((b" " if given else b"") + b" ".join(words))
                given = True
        sizes.append(end - begin)
        removed.append(int(g.sum()))
        digests.append(digest.hexdigest())
        begin = end
    ids = pa.ipc.open_stream(zstandard.decompress(row["extra"])).read_all().column("own").combine_chunks()
    return pa.table({"doc_id": ids, "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "kept_sha256": pa.array(digests, pa.string())})


def _salted(rows: DataFrame, few: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Rows joined with one row per key; a frequent key's rows are dealt to ``salts`` tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("block", "content"), F.lit(salts)).cast("int")) \
        .join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"])


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, family: int = FAMILY) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    spark: SparkSession = docs.sparkSession
    n = partitions(spark)
    kind = dict(docs.dtypes)["doc_id"]
    table = f"tessera_words_{uuid.uuid4().hex}"
    block_rows(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("doc_id").alias("own")), ["own"], block_bytes) \
        .write.bucketBy(n, "block").option("path", shared_folder(spark, "words-blocks")).saveAsTable(table)
    try:
        blocks = spark.table(table)
        slim = blocks.select("block", "data", "sizes")
        same = Window.partitionBy("mark", "content")
        seen = slim.mapInArrow(_seen, "mark long, content long, block long, places long")
        counted = stored(seen.withColumn("total", F.sum("places").over(same)).withColumn("holder", F.min("block").over(same)), "words-counted")
        one = counted.where("block = holder").select("mark", "content", "block", (F.col("total") == 1).alias("alone"))
        groups = one.groupBy("mark").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
        ask = _salted(one, groups, "mark").select("block", "content", "alone", (F.col("contents") > family).alias("large"))
        sent = stored(slim.groupBy("block").cogroup(ask.groupBy("block")).applyInArrow(_sent, SENT), "words-sent")
        built = sent.where("words is not null").select("mark", "block", "content", "alone", "words").repartition(n, "mark") \
            .sortWithinPartitions("mark").mapInArrow(_built, "block long, content long, bits long")
        leaf = sent.where("prefix is not null")
        deep = leaf.groupBy("prefix").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
        nodes = _salted(leaf.where("alone").select("prefix", "block", "content", "at"), deep, "prefix") \
            .groupBy("block", "content").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))
        whole = counted.where("total > 1").select("block", "content", F.lit(WHOLE).cast("long").alias("bits"))
        decided = whole.unionByName(built).unionByName(nodes)
        return stored(blocks.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(
            _removed, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"), "words-out")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def op11_repeat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, 35 words."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
