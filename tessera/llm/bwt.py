"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A shard's transform is built once, by sorting its own suffixes. Merging k
shards then compares no text: an interleave says, place by place, which
shard's next suffix comes. It starts as shard after shard. In round h every
suffix, in the order of the interleave, hands its preceding symbol to a
stable distribution by symbol, and the suffix one symbol longer takes the
place so found: after round h the interleave is right for the first h
symbols, and a boundary that appears in round h separates suffixes with a
common prefix of h-1 symbols. Where none has appeared after ``depth`` rounds,
neighbours share ``depth`` symbols: a repeated interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """Symbols before each suffix in suffix order (0: the suffix is a whole string), and each suffix's place in the
    shard's text: its strings one after another, each with a terminator. Terminators sort first, by string."""

    before: np.ndarray
    place: np.ndarray
    n_strings: int


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[by:], filled up with zeros."""
    out = np.zeros_like(x)
    if by < len(x):
        out[:len(x) - by] = x[by:]
    return out


def shard(strings: np.ndarray, lengths: np.ndarray) -> Shard:
    """The transform of strings given as joined bytes and their lengths."""
    n, m = len(strings) + len(lengths), len(lengths)
    ends = np.cumsum(lengths + 1) - 1  # the terminators' places
    text = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[ends] = False
    text[body] = strings.astype(np.int64) + 1
    left = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols up to the terminator
    rank, h = np.zeros(n, np.int64), 6
    for i in range(h):  # six symbols of nine bits
        rank = rank << 9 | np.where(left >= i, _shifted(text, i), 0)
    longest = int(lengths.max(initial=0)) + 1
    while True:
        values, rank = np.unique(rank, return_inverse=True)
        if h >= longest or len(values) == n:
            break
        rank = rank * (n + 2) + np.where(left >= h, _shifted(rank + 1, h), 0)
        h *= 2
    place = np.argsort(rank, kind="stable")
    before = np.zeros(n, np.uint16)
    before[1:] = text[:-1]
    return Shard(before[place], place, m)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the merged order of all suffixes, numbered shard by shard in their own order, and the common
    prefix of each with the one before it, cut off at ``depth`` (255 at most)."""
    sizes = np.array([len(s.before) for s in shards])
    offset = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    symbol = np.concatenate([s.before for s in shards]) if shards else np.empty(0, np.uint16)
    longer = np.zeros(n, np.int32)  # the suffix that is one symbol longer
    for s, o in zip(shards, offset, strict=True):
        by_symbol = np.argsort(s.before, kind="stable")
        longer[o + by_symbol] = o + np.arange(len(by_symbol))
    fixed = np.concatenate([o + np.arange(s.n_strings) for s, o in zip(shards, offset, strict=True)]).astype(np.int32) \
        if shards else np.empty(0, np.int32)
    m = len(fixed)
    order = np.arange(n, dtype=np.int32)
    lcp = np.zeros(n, np.uint8)  # rounds without a boundary
    block = np.zeros(n, np.int32)
    new = np.zeros(n, bool)
    new[:m + 1] = True  # every terminator is a block of its own
    for _ in range(depth):
        s = symbol[order]
        turn = np.argsort(s, kind="stable")[m:]  # without the m suffixes that are whole strings
        s, source = s[turn], block[turn]
        order[m:] = longer[order[turn]]
        order[:m] = fixed
        np.not_equal(source[1:], source[:-1], out=new[m + 1:])
        new[m + 1:] |= s[1:] != s[:-1]
        lcp += ~new
        np.cumsum(new, out=block)
        if n and block[-1] == n:
            break
    return order, lcp


def repeated(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Start places of the intervals of suffixes that share ``depth`` symbols (singles included)."""
    return np.flatnonzero(lcp < depth) if len(lcp) else np.empty(0, np.int64)
