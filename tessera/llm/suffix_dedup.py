"""Removal of byte strings that an earlier document holds, by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in
a document with a smaller doc_id. One transform of the whole corpus would be
one task's, so the strings are dealt out first, without loss: each 50-byte
window has a mark, its 20-byte substring of the smallest hash (leftmost of
equals), which depends on the window alone. Windows with the same mark that
follow one another form a passage. Equal windows have equal marks, so the
passages of one mark, its family, hold every repeat of their windows.

1. Passages are hashed in blocks of documents; of equal passages in a block
   the smallest doc_id stands for all. Per mark, the blocks' figures meet: the
   smallest doc_id of each passage, and whether the family has several
   different passages from several documents.
2. Equal passages are thus decided: all but the smallest document's go whole.
3. Different passages of a family may share windows. Each different passage's
   bytes go, once, to the family's task, which first sets aside those that
   share no 40 bytes around the mark with another document (they cannot share
   50). What one block sent is a shard. The shards' transforms are merged by interleave refinement (``bwt.py``), whose
   boundaries give the common prefixes; an interval of suffixes that share 50
   bytes and come from several documents is a repeat, and its windows in all
   but the smallest document go.

A family of more than ``FAMILY`` different passages (a template line filled with
names) is dealt out once more: each window holds one of three 40-byte strings
around the mark, so a passage goes to the groups of its three strings, where
all passages are that can share a window with it, and its windows to go are
those found in any of them. Strings around a line that a share of all documents holds
are as frequent as its mark, so a family of more than ``SPLIT`` times ``FAMILY`` passages is
dealt out by its windows, each by itself: equal windows of a block are one row of
the smallest doc_id, as equal passages are, and all but the smallest document's go.

Scale: a frequent passage is one row per block, not per document, wherever it
goes. Texts are stored once, compressed and bucketed by block, so that the
three passes over them (passages, shards, removal) read them in place and
only figures move: sixteen bytes per passage (one per 16 bytes of text)
without equal passages of a block, then the ids of passages with a decision.
Families are merged in batches of bounded size; a large one is dealt out by
40-byte strings or by windows, so that no merge grows with the table, and a
window is one row per block, however many texts hold it.

Cases: NULL and empty texts have no bytes; a document under 50 bytes loses
none; a NULL doc_id neither removes nor loses; rows that share a doc_id do
not remove from each other; a text may repeat itself. An empty table gives no
rows. Only doc_id, text and the columns named in ``carry`` are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import merge, repeated, shard
from .common import partitions, shared_folder, stored

LENGTH = 50
MARK = 20
MARKS = LENGTH - MARK + 1  # marks to choose from in a window
BLOCK_BYTES = 1 << 21
BLOCK_DOCS = 60_000  # document numbers in a block fit 16 bits
SEGMENT = 1 << 16
BATCH_BYTES = 1 << 18  # merged at once, unless one family is larger; the arrays then stay in a processor's cache
SHARDS = 8
BACKS = (20, 10, 0)  # the strings of AROUND bytes that decide a passage's windows start so many bytes before its mark
AROUND = 40
FAMILY = 4096  # different passages of one mark that are compared together
SPLIT = 2  # times as many are dealt out by the strings around the mark, more by their windows

_BYTE = np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _C1 + (b ^ b >> np.uint64(29))) * _C2
    return x ^ x >> np.uint64(32)


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:span - width], x[width - span:])


def passages(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of joined documents that end at ``ends``: (mark, doc, low, high, place) of every passage: the 64-bit hash of its
    mark, its document's number, its first and last window, and the mark's place."""
    parts = []
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    for seg in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[seg:seg + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        h1 = _BYTE[part]
        h2 = _join(h1[:-1], h1[1:])
        h4 = _join(h2[:-2], h2[2:])
        h8 = _join(h4[:-4], h4[4:])
        h16 = _join(h8[:-8], h8[8:])
        mark = _join(h16[:len(part) - MARK + 1], h4[16:])
        place = np.arange(len(mark), dtype=np.uint64)
        chosen = (_slide(mark & np.uint64(0xFFFFFFFF00000000) | place, MARKS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that stand in one document
        inside = np.ones(n + 1, bool)
        for e in ends[(ends > seg) & (ends < seg + n + LENGTH - 1)].tolist():
            inside[max(0, e - seg - LENGTH + 1):min(n, e - seg)] = False
        window = np.flatnonzero(inside[:n])
        if not len(window):
            continue
        at = chosen[window]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(window)])) - 1
        low, high = window[first] + seg, window[last] + seg
        parts.append((mark[at[first]], np.searchsorted(starts, low, "right") - 1, low, high, at[first] + seg))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
    # empty documents share their start with the next: the last of equal starts holds the window
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def contents(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit hashes of the passages' bytes."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(low.tolist(), (high + LENGTH).tolist(), strict=True)), np.uint64, len(low))


class Block:
    """Documents of a block, their passages, and per different passage the smallest document."""

    def __init__(self, row: dict) -> None:
        raw = zstandard.decompress(row["data"]) if row["data"] else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)  # is the id not NULL?
        mark, doc, low, high, place = passages(self.data, self.ends)
        keep = self.known[doc] if len(doc) else np.empty(0, bool)
        self.mark, self.doc, self.low, self.high, self.place = mark[keep], self.ids[doc[keep]], low[keep], high[keep], place[keep]
        self.content = contents(self.data, self.low, self.high)
        order = np.lexsort((self.doc, self.content))
        c = self.content[order]
        first = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.empty(0, bool)
        self.pick = order[first]  # one passage of the smallest document for each content, by content
        self.group = np.empty(len(c), np.int64)
        self.group[order] = np.cumsum(first) - 1
        self.least = self.doc[self.pick]

    def places(self, content: np.ndarray) -> np.ndarray:
        """Numbers (in ``pick``) of the given contents, which all occur."""
        return np.searchsorted(self.content[self.pick], content)


def each_window(x: Block, pick: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of passages of a block, window by window: the passage's place in ``pick``, the window's offset in it, its 64-bit
    hash, and the smallest document of the passages with an equal window."""
    count = x.high[pick] - x.low[pick] + 1
    owner = np.repeat(np.arange(len(pick)), count)
    offset = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    at = x.low[pick][owner] + offset
    window = contents(x.data, at, at)
    return owner, offset, window, smallest(window, x.doc[pick][owner])


def smallest(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of every row, the smallest document of the rows with its key."""
    if not len(key):
        return doc
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    least = np.empty_like(doc)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(k))))
    return least


def block_rows(docs: DataFrame, carry: list[str], block_bytes: int) -> DataFrame:
    """Documents joined to blocks: block, data (compressed), sizes, ids, known, extra (carried columns as Arrow)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        rows: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal no, texts, rows, size
            table = pa.Table.from_batches(rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select([*carry]).schema) as w:
                w.write_table(table.select([*carry]))
            ids = table.column("doc_id").combine_chunks()
            out = {"block": [task << 32 | no], "data": [zstandard.compress(b"".join(texts), 1)],
                   "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()],
                   "ids": [ids.cast(pa.int64()).fill_null(0).to_numpy().tobytes()],
                   "known": [ids.is_valid().to_numpy(zero_copy_only=False).tobytes()],
                   "extra": [zstandard.compress(sink.getvalue().to_pybytes(), 1)]}
            no, texts, rows, size = no + 1, [], [], 0
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            at = 0
            for i, t in enumerate(b.column(1)):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size >= block_bytes or len(texts) >= BLOCK_DOCS:
                    rows.append(b.slice(at, i + 1 - at).select(["doc_id", *carry]))
                    at = i + 1
                    yield flush()
            if at < b.num_rows:
                rows.append(b.slice(at).select(["doc_id", *carry]))
        if texts:
            yield flush()
    kinds = "block long, data binary, sizes binary, ids binary, known binary, extra binary"
    return docs.select("doc_id", "text", *carry).mapInArrow(run, kinds)


def _seen(n: int):
    """Blocks -> for each bucket of marks: bucket, block, and joined arrays (doc numbers' ids, marks, contents, docs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = Block(row)
                mark, content, doc = x.mark[x.pick], x.content[x.pick], x.least
                ids, number = np.unique(doc, return_inverse=True)
                bucket = (mark % np.uint64(n)).astype(np.int64)
                order = np.lexsort((mark, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                head = zstandard.compress(np.diff(ids, prepend=0).tobytes(), 1)
                out: dict[str, list] = {"bucket": [], "block": [], "ids": [], "data": []}
                for k in range(n):
                    o = order[cuts[k]:cuts[k + 1]]
                    if len(o):
                        out["bucket"].append(k)
                        out["block"].append(row["block"])
                        out["ids"].append(head)
                        # 48 bits of the mark: families that then fall together are told apart by their bytes
                        out["data"].append((mark[o] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                                           + (mark[o] >> np.uint64(32)).astype(np.uint16).tobytes()
                                           + content[o].tobytes() + number[o].astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()),
                                                                 ("ids", pa.binary()), ("data", pa.binary())]))
    return run


def _decided(most: int):
    """Of a bucket of marks, per block: contents that go whole, and contents whose bytes are to be compared (``ask``;
    ``split`` where their family has more than ``most`` passages, ``each`` where it has more than ``SPLIT`` times as many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decisions(batches, most)
    return run


def _decisions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    blocks, marks, content, docs, source = [], [], [], [], []
    for b in batches:
        for r in b.to_pylist():
            n = len(r["data"]) // 16
            low = np.frombuffer(r["data"], np.uint32, n)
            high = np.frombuffer(r["data"], np.uint16, n, 4 * n)
            ids = np.cumsum(np.frombuffer(zstandard.decompress(r["ids"]), np.int64))
            marks.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
            content.append(np.frombuffer(r["data"], np.uint64, n, 6 * n) if 6 * n % 8 == 0
                           else np.frombuffer(r["data"][6 * n:14 * n], np.uint64))
            docs.append(ids[np.frombuffer(r["data"], np.uint16, n, 14 * n)])
            source.append(np.full(n, len(blocks), np.int32))
            blocks.append(r["block"])
    if not blocks:
        return
    parts = [marks, content, docs, source]
    del marks, content, docs, source, b, r  # a bucket's figures are held once
    for k, x in enumerate(parts):
        parts[k] = np.concatenate(x)
    del x
    order = np.lexsort((parts[2], parts[1], parts[0]))
    for k in range(4):
        parts[k] = parts[k][order]
    m, c, d, s = parts
    del order, parts
    new_mark = np.concatenate(([True], m[1:] != m[:-1]))
    new = new_mark | np.concatenate(([True], c[1:] != c[:-1]))
    first = np.flatnonzero(new)
    least = d[first]  # smallest document of each passage
    group = np.cumsum(new) - 1
    family = (np.cumsum(new_mark) - 1)[first]
    lead = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1])))
    mixed = np.minimum.reduceat(least, lead) != np.maximum.reduceat(least, lead)  # different passages, several documents
    whole = d > least[group]
    ask = ~whole & mixed[family][group]
    size = np.diff(np.append(lead, len(family)))
    large, huge = (size > most)[family][group], (size > SPLIT * most)[family][group]
    for what, rows in (("whole", np.flatnonzero(whole)), ("ask", np.flatnonzero(ask & ~large)),
                       ("split", np.flatnonzero(ask & large & ~huge)), ("each", np.flatnonzero(ask & huge))):
        rows = rows[np.argsort(s[rows], kind="stable")]
        cuts = np.searchsorted(s[rows], np.arange(len(blocks) + 1))
        out = {"block": [], "what": [], "data": []}
        for k, block in enumerate(blocks):
            if cuts[k] < cuts[k + 1]:
                out["block"].append(block)
                out["what"].append(what)
                out["data"].append(c[rows[cuts[k]:cuts[k + 1]]].tobytes())
        yield pa.RecordBatch.from_pydict(out, DECISION)


DECISION = pa.schema([("block", pa.int64()), ("what", pa.string()), ("data", pa.binary())])
SHARD = "bucket int, block long, marks binary, contents binary, docs binary, sizes binary, offsets binary, data binary"


def _picked(x: Block, asked: pd.DataFrame, what: str) -> np.ndarray:
    """The passages of a block whose contents are named in rows of ``what``."""
    parts = [np.frombuffer(d, np.uint64) for d in asked["data"][asked["what"] == what]]
    return x.pick[x.places(np.unique(np.concatenate(parts)))] if parts else np.empty(0, np.int64)


def _dealt(x: Block, asked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Passages of a block that are asked for and the key by which each is dealt: its mark, or, of large families,
    the hash of each of its strings around the mark."""
    picks, large = [_picked(x, asked, "ask")], _picked(x, asked, "split")
    keys = [x.mark[picks[0]]]
    view = memoryview(x.data)
    for back in BACKS:
        low = x.place[large] - back
        fits = (low >= x.low[large]) & (low + AROUND <= x.high[large] + LENGTH)
        picks.append(large[fits])
        keys.append(np.fromiter((xxhash.xxh3_64_intdigest(view[a:a + AROUND], back) for a in low[fits].tolist()), np.uint64, int(fits.sum())))
    return np.concatenate(picks), np.concatenate(keys)


def _shards(n: int):
    """A block and the contents asked of it -> their bytes, per bucket of marks, or of the strings around the mark;
    of ``each`` only marks and docs: their windows' hashes and smallest documents, per bucket of windows."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SHARD.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        x = Block(left.to_dict("records")[0])
        pick, key = _dealt(x, right)
        bucket = (key % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pick, key = pick[order], key[order]
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        out = []
        for k in range(n):
            p = pick[cuts[k]:cuts[k + 1]]
            if len(p):
                joined = b"".join(x.data[a:b].tobytes() for a, b in zip(x.low[p].tolist(), (x.high[p] + LENGTH).tolist(), strict=True))
                out.append((k, left["block"].iloc[0], (key[cuts[k]:cuts[k + 1]] & np.uint64(0xFFFFFFFFFFFF)).tobytes(), x.content[p].tobytes(),
                            x.doc[p].tobytes(), (x.high[p] - x.low[p] + LENGTH).astype(np.int64).tobytes(),
                            (x.place[p] - x.low[p]).astype(np.int64).tobytes(), zstandard.compress(joined, 1)))
        _, _, window, least = each_window(x, _picked(x, right, "each"))
        window, first = np.unique(window, return_index=True)
        least, bucket = least[first], (window % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        for k in np.unique(bucket).tolist():
            o = order[cuts[k]:cuts[k + 1]]
            out.append((k, left["block"].iloc[0], window[o].tobytes(), b"", zstandard.compress(least[o].tobytes(), 1), b"", b"", b""))
        return pd.DataFrame(out, columns=columns)
    return run


def windows_to_go(strings: list[list[np.ndarray]], docs: list[np.ndarray], depth: int = LENGTH) -> list[np.ndarray]:
    """Of shards of strings (of up to depth + 63 bytes) and their documents: per string, as bits, which of its
    ``depth``-byte windows also stand in a string of a smaller document."""
    shards = [shard(np.concatenate(s), np.array([len(x) for x in s])) for s in strings]
    order, lcp = merge(shards, depth)
    starts = repeated(lcp, depth)
    # of every suffix, in the shards' own orders: its string and its offset in it
    string, offset, base = [], [], 0
    for s, t in zip(shards, strings, strict=True):
        sizes = np.array([len(x) + 1 for x in t])
        owner = np.repeat(np.arange(len(t)), sizes)[s.place]
        string.append(owner + base)
        offset.append(s.place - (np.cumsum(sizes) - sizes)[owner])
        base += len(t)
    string, offset = np.concatenate(string)[order], np.concatenate(offset)[order]
    doc = np.concatenate(docs)[string]
    least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
    hit = np.flatnonzero(least < doc)
    bits = np.zeros(base, np.uint64)
    np.bitwise_or.at(bits, string[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return np.split(bits, np.cumsum([len(t) for t in strings])[:-1])


def may_repeat(data: np.ndarray, sizes: np.ndarray, offset: np.ndarray, family: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of joined passages with their mark at ``offset``: may a window of theirs stand in another document's of the family?

    A window that starts 20 or more bytes before the mark holds the 20 bytes before and the mark, one that starts 10 to
    19 before holds 10 before and 10 after it, and one that starts later holds the 20 after it: 40 bytes at a known
    distance from the mark. A passage none of whose three such strings another document's shares has no repeat."""
    ends = np.cumsum(sizes)
    start = ends - sizes
    fits = [(offset >= back) & (offset - back + AROUND <= sizes) for back in BACKS]
    around = np.zeros((len(BACKS), len(sizes)), np.uint64)
    at = 0
    while at < len(sizes):  # a batch of bytes has hashes of forty times its size
        upto = max(at + 1, int(np.searchsorted(ends, start[at] + BATCH_BYTES, "right")))
        h1 = _BYTE[data[start[at]:ends[upto - 1]]]
        h2 = _join(h1[:-1], h1[1:])
        h4 = _join(h2[:-2], h2[2:])
        h8 = _join(h4[:-4], h4[4:])
        h16 = _join(h8[:-8], h8[8:])
        for h, fit, back in zip(around, fits, BACKS, strict=True):
            rows = at + np.flatnonzero(fit[at:upto])
            low = (start + offset)[rows] - back - start[at]
            h[rows] = _join(_join(h16[low], h16[low + 16]), h8[low + 32])
        at = upto
    out = np.zeros(len(sizes), bool)
    for h, fit in zip(around, fits, strict=True):
        rows = np.flatnonzero(fit)
        order = np.lexsort((doc[rows], h[rows], family[rows]))
        f, h, d = family[rows][order], h[rows][order], doc[rows][order]
        first = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (h[1:] != h[:-1])))) if len(rows) else rows
        if len(first):
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            out[rows[order]] |= np.repeat(several, np.diff(np.append(first, len(rows))))
    return out


def _known(windows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Blocks' windows and their smallest documents -> per block: windows that another block has of a smaller document."""
    doc = np.concatenate([d for _, _, d in windows])
    gone = np.split(smallest(np.concatenate([w for _, w, _ in windows]), doc) < doc, np.cumsum([len(d) for _, _, d in windows])[:-1])
    out = [(block, w[g].tobytes()) for (block, w, _), g in zip(windows, gone, strict=True) if g.any()]
    return pa.RecordBatch.from_pydict({"block": [b for b, _ in out], "what": ["window"] * len(out), "data": [w for _, w in out]}, DECISION)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a bucket of marks -> per block: contents and the windows of them that go, as bits; of a bucket of windows:
    those that go."""
    block, mark, content, doc, size, offset, joined = [], [], [], [], [], [], []
    windows: list[tuple[int, np.ndarray, np.ndarray]] = []
    for b in batches:
        for r in b.to_pylist():
            if not r["sizes"]:
                windows.append((r["block"], np.frombuffer(r["marks"], np.uint64), np.frombuffer(zstandard.decompress(r["docs"]), np.int64)))
                continue
            sizes = np.frombuffer(r["sizes"], np.int64)
            joined.append(np.frombuffer(zstandard.decompress(r["data"]), np.uint8))
            size.append(sizes)
            offset.append(np.frombuffer(r["offsets"], np.int64))
            mark.append(np.frombuffer(r["marks"], np.uint64))
            content.append(np.frombuffer(r["contents"], np.uint64))
            doc.append(np.frombuffer(r["docs"], np.int64))
            block.append(np.full(len(sizes), r["block"], np.int64))
    if windows:
        yield _known(windows)
    if not block:
        return
    block, mark, content, doc, size, offset, joined = (np.concatenate(x) for x in (block, mark, content, doc, size, offset, joined))
    begin_of = np.cumsum(size) - size
    chosen = np.flatnonzero(may_repeat(joined, size, offset, mark, doc))
    if not len(chosen):
        return
    order = chosen[np.lexsort((block[chosen], mark[chosen]))]
    text = {i: joined[a:b] for i, a, b in zip(chosen.tolist(), begin_of[chosen].tolist(), (begin_of + size)[chosen].tolist(), strict=True)}
    families = np.flatnonzero(np.concatenate(([True], mark[order][1:] != mark[order][:-1])))
    ends = np.append(families[1:], len(order))
    total = np.cumsum(size[order])
    at = 0
    while at < len(families):  # whole families, up to BATCH_BYTES at once
        begin = families[at]
        base = total[begin - 1] if begin else 0
        upto = max(at + 1, int(np.searchsorted(total[ends - 1], base + BATCH_BYTES, "right")))
        rows = order[begin:ends[upto - 1]]
        rows = rows[np.argsort(block[rows], kind="stable")]
        parts = np.array_split(rows, min(SHARDS, len(rows)))  # neighbouring blocks' passages
        gone = windows_to_go([[text[i] for i in p.tolist()] for p in parts], [doc[p] for p in parts])
        hits: dict[int, list[tuple[int, int]]] = {}
        for p, bits in zip(parts, gone, strict=True):
            for k in np.flatnonzero(bits).tolist():
                hits.setdefault(int(block[p[k]]), []).append((p[k], bits[k]))
        out = {"block": list(hits), "what": ["part"] * len(hits),
               "data": [content[[i for i, _ in h]].tobytes() + np.array([x for _, x in h], np.uint64).tobytes() for h in hits.values()]}
        yield pa.RecordBatch.from_pydict(out, DECISION)
        at = upto


def gone_windows(x: Block, whole: np.ndarray, part: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Windows of a block that go, by place: passages of other than the block's smallest document, passages whose
    content goes whole, and the given windows (bits from the passage's first) of the smallest document's."""
    gone = np.zeros(len(x.data) + 1, np.int64)  # +1 at a first, -1 after a last window
    go = x.doc > x.least[x.group] if len(x.doc) else np.empty(0, bool)
    if len(whole):
        all_of = np.zeros(len(x.pick), bool)
        all_of[x.places(whole)] = True
        go |= all_of[x.group]
    np.add.at(gone, x.low[go], 1)
    np.add.at(gone, x.high[go] + 1, -1)
    if len(part):
        of = np.zeros(len(x.pick), np.uint64)
        np.bitwise_or.at(of, x.places(part), bits)  # a passage of a large family is decided in up to three groups
        rows = np.flatnonzero(~go & (of[x.group] > 0))
        mask = of[x.group[rows]]
        for j in range(MARKS):
            hit = rows[(mask >> np.uint64(j) & np.uint64(1)).astype(bool)]
            np.add.at(gone, x.low[hit] + j, 1)
            np.add.at(gone, x.low[hit] + j + 1, -1)
    return np.flatnonzero(np.cumsum(gone)[:-1] > 0)


def _window_bits(x: Block, pick: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contents of the passages of ``pick`` and, as bits, their windows of which the block has one of a smaller document
    or that are among ``gone``."""
    owner, offset, window, least = each_window(x, pick)
    hit = np.flatnonzero((least < x.doc[pick][owner]) | np.isin(window, gone))
    bits = np.zeros(len(pick), np.uint64)
    np.bitwise_or.at(bits, owner[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return x.content[pick], bits


def _removed(carry: list[str], with_text: bool, names: list[str]):
    """A block and the decisions for it -> a row per document."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=names)
        row = left.to_dict("records")[0]
        x = Block(row)
        of = {w: [np.frombuffer(d, np.uint64) for d in right["data"][right["what"] == w]] for w in ("whole", "part", "window")}
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.uint64)
        each, bits = _window_bits(x, _picked(x, right, "each"), cat(of["window"]))
        window = gone_windows(x, cat(of["whole"]), cat([each, *(p[:len(p) // 2] for p in of["part"])]), cat([bits, *(p[len(p) // 2:] for p in of["part"])]))
        cover = np.zeros(len(x.data) + 1, np.int32)
        cover[:-1] += np.bincount(window, minlength=len(x.data)).astype(np.int32)[:len(x.data)] if len(window) else 0
        np.subtract.at(cover, window + LENGTH, 1)
        gone = np.cumsum(cover)[:-1] > 0
        data = x.data
        out = []
        begin = 0
        for k, end in enumerate(x.ends.tolist()):
            g, d = gone[begin:end], data[begin:end]
            n = int(g.sum())
            spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if n else 0
            kept = d[~g].tobytes() if n else d.tobytes()
            out.append([int(x.ids[k]) if x.known[k] else None, end - begin, n, spans, hashlib.sha256(kept).hexdigest()]
                       + ([kept.decode("utf-8", "ignore")] if with_text else []))
            begin = end
        frame = pd.DataFrame(out, columns=names[:5 + with_text])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        if carry:
            extra = pa.ipc.open_stream(zstandard.decompress(row["extra"])).read_all()
            for c in carry:
                frame[f"x_{c}"] = pd.Series(extra.column(c).to_pylist(), dtype=object)
        return frame
    return run


def suffix_dedup(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False,
                 block_bytes: int = BLOCK_BYTES, family: int = FAMILY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also kept_text (a
    character that is cut in two is left out), and every column of ``carry`` as ``x_<name>``."""
    spark: SparkSession = docs.sparkSession
    carry = carry or []
    n = partitions(spark)
    table = f"tessera_blocks_{uuid.uuid4().hex}"
    block_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), carry, block_bytes).write \
        .bucketBy(n, "block").option("path", shared_folder(spark, "suffix-blocks")).saveAsTable(table)
    blocks = spark.table(table)
    slim = blocks.drop("extra")
    seen = slim.mapInArrow(_seen(n), "bucket int, block long, ids binary, data binary")
    decided = stored(seen.repartitionById(n, "bucket").mapInArrow(_decided(family), "block long, what string, data binary"), "suffix-decided")
    ask = decided.where("what <> 'whole'")
    sent = slim.groupBy("block").cogroup(ask.groupBy("block")).applyInPandas(_shards(n), SHARD)
    parts = stored(sent.repartitionById(n, "bucket").mapInArrow(_merged, "block long, what string, data binary"), "suffix-merged")
    decisions = decided.where("what IN ('whole', 'each')").unionByName(parts)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text + [f"x_{c}" for c in carry]
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text \
        + "".join(f", x_{c} {kinds[c]}" for c in carry)
    out = stored(blocks.groupBy("block").cogroup(decisions.groupBy("block")).applyInPandas(
        _removed(carry, with_text, names), schema), "suffix-out")
    spark.sql(f"DROP TABLE {table}")
    return out


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, 50 bytes."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
