"""op11 against counting every window, on given and odd documents, and its tree against sorted suffixes."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import DOCS, odd_rows

from tessera.llm import repeat_trees as rt

SF = "/root/testdata/sf0.001"


def brute(rows, length=rt.LENGTH):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    windows = Counter(tuple(w[k:k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = Counter()
    for i, w in words:
        gone = {k + j for k in range(len(w) - length + 1) if windows[tuple(w[k:k + length])] > 1 for j in range(length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def check(df, **how):
    got = Counter(tuple(r) for r in rt.remove_repeats(df, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    return got


def test_given_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def mixed_rows():
    """Passages within documents and across, edited copies, one 8-word string in many surroundings."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(rng.randrange(30, 80))] for _ in range(12)]
    line = " ".join(f"line{i}" for i in range(8)).split()
    texts = []
    for i in range(160):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(shared))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        if i % 3 == 0:
            w += [word() for _ in range(20)] + line + [word() for _ in range(20)]
        if i % 10 == 0:
            w += ["and", "on"] * rng.randrange(10, 60)
        texts.append((" " if i % 2 else "\n\t").join(w))
    texts += texts[:4]
    return [(i, t, "en", "s", 1, "k", "z", "b") for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 2000}, {"block_bytes": 5000, "family": 3}, {"family": 1}])
def test_repeats_and_prefix_lengths(spark, how):
    check(spark.createDataFrame(mixed_rows(), DOCS), **how)


def test_odd_rows(spark):
    check(spark.createDataFrame(odd_rows(), DOCS).repartition(3), block_bytes=3000)


def test_text_ids_and_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [("a", long), ("b", long[1000:3000]), (None, "é " * 200), ("c", "x" * 3_000_000), ("c", None)]
    got = check(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sum(n > 0 for _, _, n, _ in got) == 3


def test_empty(spark):
    assert rt.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_tree_is_the_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        strings = [rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint64) for _ in range(rng.integers(1, 9))]
        string, offset, depth = rt.suffix_tree(strings)
        suffixes = [strings[s][o:].tolist() for s, o in zip(string, offset, strict=True)]
        assert len(suffixes) == sum(map(len, strings))
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1], suffixes[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert depth[k] == same and (same == min(len(a), len(b)) or a[same] < b[same])
