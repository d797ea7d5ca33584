"""SentencePiece encoding and decoding with a max-plus parallel scan.

A giant text is split into chunks at fixed places, in the middle of words if
need be. The state at a cut is the piece that covers the character before it:
which piece, and how far it reaches past the cut. A chunk gives, from every
possible state at its left cut, the best path to every possible state at its
right cut: a small transfer matrix in the max-plus semiring, where a path
weighs minus its number of pieces and what cannot follow weighs minus
infinity. Matrices are multiplied associatively, in blocks and blocks of
blocks, which yields each chunk's true left state and, from the weights, the
index of its first piece; then every chunk is traced back by itself.

The model's pieces were made by merges, and its encoding of a text is not the
path of the largest summed score but the only path in which every two
neighbouring pieces are compatible: encoding their joined text gives the two
back. (If all neighbours are compatible, no merge across any border comes
first, so the merges rebuild exactly these pieces.) So a step's weight is -1
if the pieces are compatible and minus infinity if not, and from a given left
state at most one path reaches each place. Pieces never hold a space mark
after another character, so a space mark after another character always
starts a piece; this is checked when the model is read, and without it whole
texts are single words to the same code.

Scale: texts up to ``chunk`` characters are one chunk, encoded in the scan of
the input with no shuffle. Of longer ones only matrices move (some dozen
entries per chunk), ``fan`` to a task, in log(chunks) rounds, then the chunks'
own text; ids are gathered per text, whose row they are part of. A word is
encoded when a worker meets it first; its ids are kept as bytes in a bounded
table, in which all words of a text are looked up and joined at once.

Cases: NULL and empty text have no ids and decode to ''. Characters without a
piece become byte pieces. The model's own normaliser comes first; what it
changes (here: nothing but the space mark itself, which decodes as a space)
shows in ``round_trip``. Ids that are NULL decode to NULL. Repeated rows and
NULL ids of documents are encoded each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, FAN = 1 << 15, 64
SPACE = "▁"
REMEMBERED = 400_000

WORDS = re.compile(rb" +[^ ]*|[^ ]+")

State = tuple[int, int]  # characters past the cut, id of the piece (or -1 - code point for bytes)
Matrix = dict[State, dict[State, int]]
START: State = (0, -(1 << 30))


class Known(dict):
    """Ids, as int32 bytes, of words in UTF-8 with spaces for space marks (the smallest form of a key); ``make`` encodes
    those not met before. Two generations of at most ``limit`` words: what was not asked for since the last change goes."""

    def __init__(self, make, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.make(word.decode().replace(" ", SPACE))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class Pieces:
    """The model's vocabulary, compatibility of neighbours, and paths."""

    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.marks_only = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces \
            and not spec.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        n = self.sp.get_piece_size()
        self.text = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: self.sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [byte_of.get(i, t.replace(SPACE, " ").encode()) for i, t in enumerate(self.text)]
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.edge = re.compile(f"[^{SPACE}](?={SPACE})")
        self.apart = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.neighbours = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        found: dict[str, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                found.setdefault(t[:3], {1, 2}).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}  # of pieces with these first characters
        self.words = Known(self.encoded)
        self.alone: dict[str, bytes] = {}  # by character, so bounded
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[str, tuple[str, str] | None] = {}
        self.sound: dict[str, bool] = {}

    def normal(self, text: str) -> str:
        """The model's own normaliser; where it only marks spaces, that is done here."""
        if self.marks_only:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return self.sp.normalize(text)

    def string(self, piece: int) -> str:
        return self.text[piece] if piece >= 0 else chr(-1 - piece)

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -1e30), -i))
            joined = parts[best] + parts[best + 1]
            if joined not in self.score:
                break
            parts[best:best + 2] = [joined]
        return parts

    def halves(self, text: str) -> tuple[str, str] | None:
        """The two parts whose merge made the piece; None for a single character."""
        found = self.made.get(text, 0)
        if found == 0:
            parts = list(text)
            while len(parts) > 2:
                best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -1e30), -i))
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            found = self.made[text] = tuple(parts) if len(parts) == 2 else None
        return found

    def follows(self, a: int, b: int) -> bool:
        """May piece b stand after piece a?"""
        if a == START[1]:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(self.string(a), self.string(b))
        return known

    def _compatible(self, x: str, y: str) -> bool:
        """Is the joined text encoded as x, y? The merges of both sides are undone from the last to the first; what
        touches at the border must not have been merged before the merge that was undone."""
        rank = lambda t: -self.score.get(t, 0.0) if len(t) > 1 else -1.0
        for t in (x, y):  # a piece that merges do not make from its characters is never part of an encoding
            if len(t) > 1 and t not in self.sound:
                self.sound[t] = self.merged(t) == [t]
            if not self.sound.get(t, True):
                return False
        before = (1e30, 0)  # of equal ranks the left merge comes first
        while True:
            across = self.score.get(x + y)
            if across is not None and (-across, 0) < before:
                return False
            left, right = rank(x), rank(y)
            if left < 0 and right < 0:
                return True
            if left > right:
                before, x = (left, 0), self.halves(x)[1]
            else:
                before, y = (right, 1), self.halves(y)[0]

    def starting(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of every piece that starts at ``at``, the longest first; bytes only for characters without a piece."""
        ids = self.ids
        for end in range(min(len(text), at + self.longest), at, -1):
            k = ids.get(text[at:end])
            if k is not None:
                yield end, k
        if text[at] not in ids:
            yield at + 1, -1 - ord(text[at])

    def path(self, text: str, first: int, at: int, stop: int) -> dict[int, tuple[int, int, int]]:
        """From piece ``first`` ending at ``at``: the piece (start, id, ids so far) that ends at each place up to
        ``stop`` and, beyond it, of each piece that covers the character before ``stop``."""
        best = {at: (at, first, 0)}
        over: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in range(at, stop):
            here = best.get(i)
            if here is None:
                continue
            for end, piece in self.starting(text, i):
                if self.follows(here[1], piece):
                    step = (i, piece, here[2] + (1 if piece >= 0 else len(chr(-1 - piece).encode())))
                    if end >= stop:
                        over[end, piece] = step
                    # at most one piece that ends here continues the path from `first`
                    best[end] = step
        self.over = over
        return best

    def encoded(self, word: str) -> bytes:
        """Ids of a whole word; two characters that stand side by side in no piece part it, and its parts are words too."""
        at, out, pairs, n = 0, [], self.neighbours, len(word)
        for i in range(1, n + 1):
            if i == n or word[i - 1:i + 1] not in pairs:
                if not at and i == n:
                    return _bytes(self.fragment(word))
                out.append(self.words[_key(word[at:i])] if i - at > 1 else self.single(word[at]))
                at = i
        return b"".join(out)

    def single(self, character: str) -> bytes:
        found = self.alone.get(character)
        if found is None:
            found = self.alone[character] = _bytes(self.fragment(character))
        return found

    def fragment(self, word: str) -> list[int]:
        """Ids of a part of a word: the only compatible path through it, longest pieces first, back from dead ends."""
        n, get, lengths, pairs = len(word), self.ids.get, self.lengths, self.pairs
        at, last, limit = 0, START[1], n
        done: list[tuple[int, int, int]] = []  # start, piece before it, end
        took: list[int] = []
        dead: set[int] = set()
        while at < n:
            for size in lengths.get(word[at:at + 3], (2, 1)):
                end = at + size
                if end > limit:
                    continue
                piece = get(word[at:end])
                if piece is None:
                    if size > 1:
                        continue
                    piece = -1 - ord(word[at])
                good = pairs.get((last, piece))
                if good is None:
                    good = self.follows(last, piece)
                if good and end not in dead:
                    done.append((at, last, end))
                    took.append(piece)
                    at, last, limit = end, piece, n
                    break
            else:  # only one piece can end here, so this place leads nowhere
                dead.add(at)
                at, last, end = done.pop()
                took.pop()
                limit = end - 1
        return self.bytes_of(took) if min(took) < 0 else took

    def bytes_of(self, pieces: list[int]) -> list[int]:
        out = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            else:
                out += [self.byte[b] for b in chr(-1 - p).encode()]
        return out

    def border(self, text: str, low: int, high: int) -> int | None:
        """The first place in [low, high), after the text's start, at which a piece starts on every path."""
        m = self.edge.search(text, max(0, low - 1), high) if self.splits else None
        return None if m is None else m.start() + 1

    def split(self, text: str) -> list[str]:
        """Words of a text that starts at a border or at its own start."""
        return self.apart.findall(text) if self.splits else [text]

    def states(self, text: str, cut: int) -> list[State]:
        """Every piece that covers the character before ``cut``, by how far it reaches past the cut."""
        return sorted({(end - cut, piece) for i in range(max(0, cut - self.longest), cut)
                       for end, piece in self.starting(text, i) if end >= cut})

    def transfer(self, text: str, left: int, right: int, entries: list[State]) -> Matrix:
        """The chunk text[left:right] as a max-plus matrix; ``text`` reaches ``longest`` characters past both cuts."""
        head = self.border(text, left, right)
        tail: dict[State, int] = {}
        middle = 0
        if head is not None:
            words = self.split(text[head:right])
            middle = sum(map(len, map(self.words.__getitem__, map(_key, words[:-1])))) // 4
            tail = self._from(text, START, right - len(words[-1]), right)
        out: Matrix = {}
        for e in entries:
            at = left + e[0]
            if at >= right:  # the piece covers the whole chunk
                out[e] = {(at - right, e[1]): 0}
            elif head is None:
                out[e] = self._from(text, e, at, right)
            elif at <= head:
                # no piece crosses the first border: one way to get there, if any; the rest is the same for all
                n = 0 if at == head else next((v for (past, _), v in self._from(text, e, at, head).items() if past == 0), None)
                if n is not None:
                    out[e] = {s: n - middle + v for s, v in tail.items()}
        return out

    def _from(self, text: str, state: State, at: int, stop: int) -> dict[State, int]:
        self.path(text, state[1], at, stop)
        return {(end - stop, piece): -step[2] for (end, piece), step in self.over.items()}

    def trace(self, text: str, left: int, right: int, entry: State, leave: State | None) -> bytes:
        """Ids, as int32 bytes, of the pieces that start in text[left:right] after ``entry`` and end with ``leave`` (None: at the text's end)."""
        at = left + entry[0]
        if at >= right:
            return b""
        head = 0 if entry == START and at == 0 else self.border(text, at, right)
        if head is None:
            return _bytes(self._trace(text, entry[1], at, right, leave))
        ids = _bytes(self._trace(text, entry[1], at, head, None))
        words = self.split(text[head:right])
        last = words if leave is None else words[:-1]
        ids += b"".join(map(self.words.__getitem__, map(_key, last)))
        return ids if leave is None else ids + _bytes(self._trace(text, START[1], right - len(words[-1]), right, leave))

    def _trace(self, text: str, first: int, at: int, stop: int, leave: State | None) -> list[int]:
        if at == stop:
            return []
        best = self.path(text, first, at, stop)
        # of the pieces that could end exactly at a border, or at the text's end, one continues the path
        step = next(s for (end, piece), s in self.over.items() if (end == stop if leave is None else (end - stop, piece) == leave))
        found = [step[1]]
        place = step[0]
        while place > at:
            step = best[place]
            found.append(step[1])
            place = step[0]
        return self.bytes_of(found[::-1])

    def packed(self, text: str) -> bytes:
        """Ids, as int32 bytes, of a text that is one chunk."""
        if self.marks_only and self.splits:
            return b"".join(map(self.words.__getitem__, WORDS.findall(_key(" " + text)))) if text else b""
        t = self.normal(text)
        return self.trace(t, 0, len(t), START, None) if t else b""

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the pieces, space marks as spaces; the space that stands before every text is still there."""
        return b"".join(map(self.raw.__getitem__, ids))


def _key(word: str) -> bytes:
    return word.replace(SPACE, " ").encode()


def _bytes(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _lists(rows: list[bytes]) -> pa.ListArray:
    """Rows of int32 bytes as a list column."""
    offsets = np.cumsum([0, *(len(r) // 4 for r in rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The model, read once per worker process."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[State, int] = {}
        for k, v in row.items():
            for j, w in b.get(k, {}).items():
                if v + w > best.get(j, -(1 << 62)):
                    best[j] = v + w
        if best:
            out[i] = best
    return out


def _pack(m: Matrix) -> list[dict]:
    return [{"e": e[0], "p": e[1], "f": f[0], "q": f[1], "w": w} for e, row in m.items() for f, w in row.items()]


def _unpack(entries: list[dict]) -> Matrix:
    out: Matrix = {}
    for x in entries:
        out.setdefault((x["e"], x["p"]), {})[x["f"], x["q"]] = x["w"]
    return out


ENTRY = "array<struct<e:int,p:int,f:int,q:int,w:long>>"
_ENTRY = pa.list_(pa.struct([("e", pa.int32()), ("p", pa.int32()), ("f", pa.int32()), ("q", pa.int32()), ("w", pa.int64())]))


def _blocks(level: DataFrame, fan: int) -> DataFrame:
    """Products of each ``fan`` neighbouring matrices: (key, no / fan, m)."""
    def run(key, frame):
        import pandas as pd
        rows = frame.sort_values("no")
        m = None
        for x in rows["m"]:
            m = _unpack(x) if m is None else product(m, _unpack(x))
        return pd.DataFrame({"key": [key[0]], "no": [key[1]], "m": [_pack(m)]})
    return level.select("key", F.floor(F.col("no") / fan).cast("long").alias("b"), "no", "m") \
        .groupBy("key", "b").applyInPandas(run, f"key string, no long, m {ENTRY}")


def _entries(level: DataFrame, known: DataFrame, fan: int) -> DataFrame:
    """States at both cuts, and index of the first id, of each matrix, from those of its block: the best path through it."""
    def run(key, left, right):
        import pandas as pd
        rows = left.sort_values("no")
        k = right.iloc[0]
        goal = (int(k["f"]), int(k["q"]))
        front: dict[State, int] = {(int(k["e"]), int(k["p"])): 0}
        steps: list[dict[State, tuple[State, int]]] = []
        for m in rows["m"]:
            come: dict[State, tuple[State, int]] = {}
            for i, row in _unpack(m).items():
                if i in front:
                    for j, w in row.items():
                        if j not in come or front[i] + w > come[j][1]:
                            come[j] = (i, front[i] + w)
            steps.append(come)
            front = {j: w for j, (_, w) in come.items()}
        out = []
        state = goal
        for no, come in zip(reversed(rows["no"].tolist()), reversed(steps), strict=True):
            before, _ = come[state]
            out.append([key[0], no, *before, *state])
            state = before
        out.reverse()
        for x, come in zip(out, [None, *steps], strict=False):
            x.append(int(k["first"]) - (0 if come is None else come[x[2], x[3]][1]))
        return pd.DataFrame(out, columns=["key", "no", "e", "p", "f", "q", "first"])
    blocks = level.select("key", F.floor(F.col("no") / fan).cast("long").alias("b"), "no", "m")
    return blocks.groupBy("key", "b").cogroup(known.withColumnRenamed("no", "b").groupBy("key", "b")) \
        .applyInPandas(run, f"key string, no long, {STATES}")


STATES = "e int, p int, f int, q int, first long"


def left_states(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """``(key, no, STATES)`` of every chunk from the matrices ``(key, no, m)``: products up, best paths down."""
    levels = [chunks.select("key", "no", "m")]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) > 0:
        levels.append(stored(_blocks(levels[-1], fan), "pieces-level"))
    ends = F.filter("m", lambda x: (x["e"] == START[0]) & (x["p"] == START[1]) & (x["f"] == 0))
    best = F.array_max(F.transform(ends, lambda x: F.struct(x["w"].alias("w"), x["q"].alias("q"))))
    known = levels[-1].select("key", "no", F.lit(START[0]).alias("e"), F.lit(START[1]).alias("p"), F.lit(0).alias("f"),
                              best["q"].alias("q"), F.lit(0).cast("long").alias("first"))
    for level in reversed(levels[:-1]):
        known = _entries(level, known, fan)
    return known


def _window(text: str, left: int, right: int, reach: int) -> tuple[str, int, int]:
    """text[left:right] with ``reach`` characters around it, and the two cuts inside that string."""
    low = max(0, left - reach)
    return text[low:right + reach], left - low, right - low


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, n_chunks, round_trip (do the ids decode to the text?)."""
    id_type = dict(docs.dtypes)["doc_id"]
    out_type = f"doc_id {id_type}, n_tokens long, ids array<int>, n_chunks int, round_trip boolean"
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            ids = [p.packed(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), _lists(ids),
                 pa.array([1 if t else 0 for t in texts], pa.int32()),
                 pa.array([decode(p, memoryview(x).cast("i")) == t for x, t in zip(ids, texts, strict=True)])],
                ["doc_id", "n_tokens", "ids", "n_chunks", "round_trip"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import xxhash
        p = pieces(model)
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                t = p.normal(text)
                key, digest = uuid.uuid4().hex, xxhash.xxh3_128_hexdigest(text.encode())
                for no, left in enumerate(range(0, len(t), chunk)):
                    right = min(len(t), left + chunk)
                    part, low, high = _window(t, left, right, p.longest)
                    m = p.transfer(part, low, high, p.states(part, low) if no else [START])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()], b.column(0).type), pa.array([key]), pa.array([digest]), pa.array([no], pa.int64()),
                         pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([part]), pa.array([_pack(m)], _ENTRY)],
                        ["doc_id", "key", "digest", "no", "low", "high", "part", "m"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for r in b.to_pylist():
                final = r["high"] == len(r["part"])
                ids = p.trace(r["part"], r["low"], r["high"], (r["e"], r["p"]), None if final else (r["f"], r["q"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_id"]], b.column(0).type), pa.array([r["key"]]), pa.array([r["digest"]]), pa.array([r["no"]], pa.int64()),
                     pa.array([r["first"]], pa.int64()), _lists([ids])],
                    ["doc_id", "key", "digest", "no", "first", "ids"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        p = pieces(model)
        for b in batches:
            rows = b.to_pylist()
            good = [r["placed"] and xxhash.xxh3_128_hexdigest(decode(p, r["ids"]).encode()) == r["digest"] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r["ids"]) for r in rows], pa.int64()), pa.array([r["ids"] for r in rows], pa.list_(pa.int32())),
                 pa.array([r["n_chunks"] for r in rows], pa.int32()), pa.array(good, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "n_chunks", "round_trip"])

    slim = docs.select("doc_id", "text")
    short = slim.where(~giant).mapInArrow(whole, out_type)
    cuts = stored(slim.where(giant).repartition(partitions(docs.sparkSession)).mapInArrow(
        cut, f"doc_id {id_type}, key string, digest string, no long, low int, high int, part string, m {ENTRY}"), "pieces-chunks")
    states = left_states(cuts, fan)
    traced = cuts.drop("m").join(states, ["key", "no"]).select("doc_id", "key", "digest", "no", "low", "high", "part", "e", "p", "f", "q", "first") \
        .mapInArrow(trace, f"doc_id {id_type}, key string, digest string, no long, first long, ids array<int>")
    whole_ids = traced.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"),
        F.array_sort(F.collect_list(F.struct("no", "first", "ids"))).alias("parts"))
    flat = F.flatten(F.col("parts.ids"))
    # the scan's weights place every chunk's first id; where they disagree with the ids themselves, round_trip is false
    placed = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("ok")), lambda a, x: F.struct(
        (a["n"] + F.size(x["ids"])).alias("n"), (a["ok"] & (x["first"] == a["n"])).alias("ok")))["ok"]
    long = whole_ids.select("doc_id", flat.alias("ids"), "digest", F.size("parts").alias("n_chunks"), placed.alias("placed")) \
        .mapInArrow(check, out_type)
    return short.unionByName(long)


def decode(p: Pieces, ids: list[int] | None) -> str | None:
    """The text of ids; the space mark that stands before every text is dropped."""
    if ids is None:
        return None
    raw = p.decode(ids)
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode_documents(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; runs per row, in the scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(p, x) for x in b.column(1).to_pylist()], pa.string())],
                                             ["doc_id", "text"])
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
