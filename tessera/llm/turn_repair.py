"""Repair of conversations whose turns should alternate, by Wagner-Fischer alignment.

The role initials of a conversation in order are a source string; the target
strings are those of the grammar ``(s?(ua)+)?``, of which there is one per
feasible length. An alignment table holds, for every row and every number of
target characters still to come, the cheapest edits of the rest: targets of
different length share their ends, so one table (two, by the target's last
character) aligns the rows to every length at once. Ukkonen's band keeps the
cells that an alignment no dearer than the incumbent, a greedy repair, can
pass. Every length of the cheapest total is backtraced, and the ASCII-least
audit of them is the conversation's.

A conversation that lies in several tasks is cut into pieces of bounded
length. A piece yields the cost of leaving it in each state (nothing given
yet, after s, after a, after u) for each state of entering it; these matrices
chain from the last piece backwards, after which every piece is backtraced by
itself for each state of entering it, and the chain forwards picks.

Scale: rows are put in order by range partitioning on (conversation, turn)
with figures only (no texts), so a conversation that holds a third of all rows
lies in many tasks. Which row is the first of equal rows is a pre-aggregated
minimum. Texts move once, to be hashed: a conversation's hash is a stream over
its rows, in which a task holds one batch and the audit, one byte per row. The
backward chain holds sixteen numbers per ``CELL`` rows of one conversation.

Cases: a NULL in any column reads as one space where its text counts (the
damage's key, role, text), so a NULL text is blank and a NULL role matches no
initial; rows with NULL conv_id are one conversation; NULL turns come first
and do not count for gaps; rows of equal turn go by the md5 of their length of
role, role and text; a conversation without rows after the damage has zeros,
an empty audit and the hash of nothing. Texts of any length are handled as a
whole. An empty table gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored

CELL_BITS = 10  # rows of a piece, at most, as a power of two
INF = 1 << 40
REROLE, DELETE, INSERT = 2, 3, 2
SPACE = " \t\n\x0b\x0c\r"
#: States between rows: nothing given yet, after s, after a, after u.
START, AFTER_S, AFTER_A, AFTER_U = range(4)
#: Cost of ending in each state: u and a, or a, are still to be inserted.
END = [0, 2 * INSERT, 0, INSERT]
INITIALS = "sua"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)


def code(initial: int, fault: int) -> str:
    """One letter for a row: its role's initial (s, u, a, other) and its fault."""
    return chr(65 + 4 * initial + fault)


class Alignment:
    """Alignment tables of a piece's rows (letters of ``code``) to targets of every length."""

    def __init__(self, codes: str) -> None:
        letters = np.frombuffer(codes.encode(), np.uint8) - 65
        self.n = len(letters)
        self.initial, fault = (letters >> 2).tolist(), letters & 3
        self.forced = ((fault == BLANK) | (fault == DUPLICATE)).tolist()
        self.late = (fault == TRUNCATED).astype(int).tolist()
        free = [k for k, f in zip(self.initial, self.forced, strict=True) if not f]
        # what deletes that must be and truncated rows cost on any path is not to spare; 8: any state to enter and leave in
        half = (self.incumbent(free) + 8) // 2 + 1
        left = (np.cumsum([not f for f in self.forced][::-1])[::-1]).tolist() + [0]
        width = left[0] + half + 1
        m = np.arange(width)
        self.need = np.where(np.stack((m % 2 == 1, m % 2 == 0)), 2, 1)  # next of m characters that end in a, in u
        twice = INSERT * m
        self.cost = np.full((self.n + 1, 2, width), INF, np.int64)
        self.cost[self.n, :, 0] = 0
        for i in range(self.n - 1, -1, -1):
            low, high = max(0, left[i] - half), min(width, left[i] + half + 1)
            below = self.cost[i + 1]
            best = below[:, low:high] + DELETE
            if not self.forced[i]:
                at = max(low, 1)
                give = below[:, at - 1:high - 1] + (self.late[i] + REROLE * (self.need[:, at:high] != self.initial[i]))
                np.minimum(best[:, at - low:], give, out=best[:, at - low:])
            step = twice[low:high]
            self.cost[i, :, low:high] = np.minimum.accumulate(best - step, axis=1) + step

    @staticmethod
    def incumbent(free: list[int]) -> int:
        """Cost of a greedy repair of the rows that need not go, from the better of two first characters."""
        costs = []
        for need in (1, 2):
            cost = 0
            for k, row in enumerate(free):
                if row == need:
                    need = 3 - need
                else:
                    cost += REROLE
                    insert = row == 3 - need and k + 1 < len(free) and free[k + 1] == need
                    need = need if insert else 3 - need
            costs.append(cost)
        return min(costs)

    def ways(self, enter: int) -> list[tuple[int, int, int, int, int]]:
        """(cost, state it leaves in, rows passed before and with a kept s or 0, table, length) of every target."""
        out = []

        def targets(base: int, i: int, first: int, state: int):
            out.append((base + int(self.cost[i, 0, 0]), state, i, 0, 0))
            for x, leave in ((0, AFTER_A), (1, AFTER_U)):
                for m in np.flatnonzero((self.cost[i, x, 1:] < INF) & (self.need[x, 1:] == first)).tolist():
                    out.append((base + int(self.cost[i, x, m + 1]), leave, i, x, m + 1))
        targets(0, 0, 2 if enter == AFTER_U else 1, enter)
        if enter == START:
            for i in range(self.n):
                if self.initial[i] == 0 and not self.forced[i]:
                    targets(DELETE * i + self.late[i], i + 1, 1, AFTER_S)
        return out

    def costs(self) -> list[int]:
        """Least cost by (state entered in, state left in), row by row."""
        out = [INF] * 16
        for enter in range(4):
            for cost, leave, *_ in self.ways(enter):
                out[4 * enter + leave] = min(out[4 * enter + leave], cost)
        return out

    def backtrace(self, i: int, x: int, m: int) -> str:
        """ASCII-least cheapest edits of the rows from ``i`` on to the last ``m`` characters of target ``x``."""
        audit = []
        while i < self.n:
            here = self.cost[i, x, m]
            if self.cost[i + 1, x, m] + DELETE == here:
                audit.append("D")
                i += 1
            elif m and self.cost[i, x, m - 1] + INSERT == here:
                audit.append("I")
                m -= 1
            else:
                kept = self.need[x, m] == self.initial[i]
                audit.append("K" if kept and self.cost[i + 1, x, m - 1] + self.late[i] == here else "R")
                i, m = i + 1, m - 1
        return "".join(audit)

    def audit(self, enter: int, after: list[int], end: bool = False) -> tuple[str, int]:
        """ASCII-least cheapest edits, entered in a state, if leaving in each state costs ``after``; and the state left in.
        ``end``: the insertions that end the conversation belong to it."""
        ways = self.ways(enter)
        least = min(c + after[leave] for c, leave, *_ in ways)
        found = []
        for c, leave, i, x, m in ways:
            if c + after[leave] == least:
                found.append(("D" * (i - 1) + "K" * (i > 0) + self.backtrace(i, x, m) + "I" * (END[leave] // INSERT * end), leave))
        return min(found)


def price(codes: str, audit: str) -> int:
    """Cost of an audit, without insertions after the last row."""
    cost, i = 0, 0
    for edit in audit:
        if edit == "I":
            cost += INSERT
            continue
        cost += {"D": DELETE, "R": REROLE, "K": 0}[edit] + (edit != "D" and (ord(codes[i]) - 65) % 4 == TRUNCATED)
        i += 1
    return cost


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key and copies (0: dropped) of every row after the damage."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.encode(F.concat(s("conv_id"), F.lit(":"), s("turn")), "UTF-8")) % 20
    role = F.when(d == 4, F.lit("user")).otherwise(s("role"))
    text = F.when(d == 1, F.lit("")).when(d == 2, F.translate(s("text"), ".!?", "")).when(d != 0, s("text"))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                      F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("key", F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8")))


PIECE = "at long, edge boolean, codes string, low long, high long, turns long, costs array<long>, audits array<string>, leaves array<int>"


def _pieces(kind: str):
    """Task function over figures sorted by place, each first of equal rows preceded by a mark: pieces of conversations.
    Those that neither begin nor end a cell are whole and get their audit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        cell, mark, turn = None, None, None

        def close():
            for k, p in enumerate(held):
                p["codes"] = "".join(p["codes"])
                p["edge"] = k in (0, len(held) - 1)
                table = Alignment(p["codes"])
                if p["edge"]:
                    p["costs"] = table.costs()
                else:
                    audit, _ = table.audit(START, END, end=True)
                    p["audits"], p["leaves"] = [audit], [START]
            return pa.RecordBatch.from_pylist(held, schema)
        schema = None
        for b in batches:
            if schema is None:
                schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("at", pa.int64()), ("edge", pa.bool_()), ("codes", pa.string()),
                                    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())),
                                    ("audits", pa.list_(pa.string())), ("leaves", pa.list_(pa.int32()))])
            for mid, first, conv, t, initial, blank, late in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first:
                    mark = mid
                    continue
                if mid >> CELL_BITS != cell:
                    if held:
                        yield close()
                    held, cell = [], mid >> CELL_BITS
                if not held or held[-1]["conv_id"] != conv:
                    held.append({"conv_id": conv, "at": mid, "codes": [], "low": None, "high": None, "turns": 0,
                                 "costs": None, "audits": None, "leaves": None})
                    turn = None
                p = held[-1]
                p["codes"].append(code(initial, BLANK if blank else DUPLICATE if mark != mid else TRUNCATED if late else OK))
                if t is not None:
                    p["low"] = t if p["low"] is None else p["low"]
                    p["turns"] += t != turn
                    p["high"] = turn = t
        if held:
            yield close()
    return run


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one conversation (at, costs): per piece, the least cost of all that follows by the state it is left in."""
    after, out = END, []
    for at, costs in sorted(zip(rows["at"], rows["costs"], strict=True), key=lambda r: r[0], reverse=True):
        out.append((at, after))
        after = [min(int(costs[4 * e + x]) + after[x] for x in range(4)) for e in range(4)]
    return pd.DataFrame(out, columns=["at", "after"])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the costs after them -> their audits and the state left in, by the state entered in."""
    for b in batches:
        audits, leaves = [], []
        for codes, after in zip(b.column("codes").to_pylist(), b.column("after").to_pylist(), strict=True):
            table = Alignment(codes)
            found = [table.audit(enter, after) for enter in range(4)]
            audits.append([a for a, _ in found])
            leaves.append([x for _, x in found])
        out = b.set_column(b.schema.get_field_index("audits"), "audits", pa.array(audits, pa.list_(pa.string())))
        out = out.set_column(b.schema.get_field_index("leaves"), "leaves", pa.array(leaves, pa.list_(pa.int32())))
        yield out.drop_columns(["after"])


class Conversation:
    """A conversation's figures from its pieces in order, then its repaired text from its rows in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.state = conv_id, START
        self.audits: list[str] = []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = None
        self.turns, self.last = 0, ""
        self.audit, self.at, self.given = None, 0, 0
        self.hash = hashlib.sha256()

    def piece(self, codes: str, low, high, turns: int, audits: list[str], leaves: list[int], edge: bool) -> None:
        letters = np.frombuffer(codes.encode(), np.uint8) - 65
        for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
            self.count[name] += int((letters & 3 == fault).sum())
        roles = "".join((INITIALS + "o")[k] for k in (letters >> 2).tolist())
        pairs = self.last + roles
        self.count["illegal"] += sum(pairs[k:k + 2] not in ("su", "ua", "au") for k in range(len(pairs) - 1))
        self.last = roles[-1:]
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        audit = audits[self.state if edge else 0]
        self.count["cost"] += price(codes, audit)
        self.audits.append(audit)
        self.state = leaves[self.state if edge else 0]

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.edit()
        self.at += 1
        if edit == "K":
            self.give(role, text)
        elif edit == "R":
            self.give(None, text)

    def insert(self) -> None:
        while self.edit() == "I":
            self.at += 1
            self.give(None, "")

    def edit(self) -> str:
        if self.audit is None:
            tail = "I" * (END[self.state] // INSERT)
            self.count["cost"] += INSERT * len(tail)
            self.audits.append(tail)
            self.audit = "".join(self.audits)
            self.size = len(self.audit) - self.audit.count("D")
        return self.audit[self.at:self.at + 1]

    def give(self, role: str | None, text: str) -> None:
        """The next repaired turn; without a role, the one its place needs."""
        if role is None:
            role = "user" if self.given % 2 == self.size % 2 else "assistant"
        self.hash.update((b"\n" if self.given else b"") + f"{role}:{text}".encode())
        self.given += 1

    def result(self) -> dict:
        self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.count, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its pieces before its rows -> one row per conversation."""
    now, schema = None, None
    for b in batches:
        if schema is None:
            schema = pa.schema([("conv_id", b.schema.field("conv_id").type), *((c, pa.int64()) for c in FIGURES),
                                ("audit", pa.string()), ("repaired_sha256", pa.string())])
        done = []
        for conv, kind, _at, _turn, _key, role, text, copies, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv)
            if kind == 0:
                now.piece(*(piece[c] for c in ("codes", "low", "high", "turns", "audits", "leaves", "edge")))
            else:
                for _ in range(copies):
                    now.row(role, text)
        yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    n = partitions(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    after = damaged(rows)
    bare = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    figures = after.where("copies > 0").select(
        "conv_id", "turn", "key", initial.alias("initial"), (F.length(bare) == 0).alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("late"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = ["conv_id", "turn", "key"]
    # the places must be the same for all who read them: bounds of ranges are sampled anew on every execution
    placed = stored(figures.drop("copy").repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("mid", F.monotonically_increasing_id()), "turns-placed")
    firsts = placed.groupBy("conv_id", "key").agg(F.min("mid").alias("mid"))
    plain = placed.select("mid", F.lit(False).alias("first"), "conv_id", "turn", "initial", "blank", "late")
    marks = firsts.select("mid", F.lit(True).alias("first"))
    pieces = stored(plain.unionByName(marks, allowMissingColumns=True).repartition(n, F.shiftright("mid", CELL_BITS))
                    .sortWithinPartitions("mid", F.desc("first")).mapInArrow(_pieces(kind), f"conv_id {kind}, {PIECE}"), "turns-pieces")
    edges = pieces.where("edge")
    costs = edges.select("conv_id", "at", "costs").groupBy("conv_id").applyInPandas(_chained, "at long, after array<long>")
    chained = edges.join(costs, "at").select(*pieces.columns, "after").mapInArrow(_audited, f"conv_id {kind}, {PIECE}")
    audited = stored(pieces.where("not edge").unionByName(chained), "turns-audited")
    struct = F.struct("codes", "low", "high", "turns", "audits", "leaves", "edge").alias("piece")
    both = audited.select("conv_id", F.lit(0).alias("kind"), "at", struct).unionByName(
        after.select("conv_id", F.lit(1).alias("kind"), "turn", "key", "role", "text", "copies"), allowMissingColumns=True)
    both = both.select("conv_id", "kind", "at", "turn", "key", "role", "text", "copies", "piece")
    return both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "at", "turn", "key").mapInArrow(
        _repaired, f"conv_id {kind}, " + "".join(f"{c} long, " for c in FIGURES) + "audit string, repaired_sha256 string")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
