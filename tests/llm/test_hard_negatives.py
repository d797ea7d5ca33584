"""op12 against exact integer products by hand, on given and odd vectors of any size."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hard_negatives as hn

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, x string, score int, block long"


def brute(rows):
    good = []
    for vid, e, label in rows:
        if e is None or label is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        good.append((vid, [math.floor(256 * v) if abs(v) < 1e300 else int(v) * 256 for v in e], (label + 1) % 10 if vid is not None and vid % 7 == 0 else label))
    last = lambda v: (v is None, v or 0)
    long = lambda v: v if -2**63 <= v < 2**63 else None
    out = Counter()
    for i, (a, x, la) in enumerate(good):
        if a is None or a % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), b, lb) for j, (b, y, lb) in enumerate(good) if j != i and len(y) == len(x)]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for ps, p, _ in [r for r in scored if r[2] == la][:5]:
            fits = [r for r in scored if r[2] != la and 50 * ps <= 100 * r[0] <= 95 * ps][:3]
            for k, (ns, n, _) in enumerate(fits):
                out[a, p, k + 1, n, long(ps), long(ns)] += 1
    return out


def check(df, **how):
    got = Counter(tuple(r) for r in hn.mine(df, **how).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    expect = brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert got == expect
    return got


def test_given_vectors(spark):
    assert len(check(spark.read.parquet(f"{SF}/embeddings.parquet"))) > 100


def odd_rows(factor=1.0, d=8, n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        e = [factor * (0.3 + rng.random()) for _ in range(d)]
        rows.append((i * 5, e, rng.randrange(4)))
    rows += [(i * 10, rows[i][1], rng.randrange(4)) for i in range(0, 60, 2)]  # repeated ids and vectors
    rows += [rows[10]] * 4 + [(3000 + i, rows[20][1], 2) for i in range(30)]  # repeated rows, ties
    rows += [(50, None, 1), (100, [1.0] * d, None), (150, [1.0, None] * (d // 2), 1), (200, [math.nan] + [1.0] * (d - 1), 1), (250, [math.inf] * d, 2),
             (None, [0.9 * factor] * d, 1), (None, [0.9 * factor] * d, 2), (300, [1.0] * 3, 1), (301, [1.1] * 3, 1), (302, [0.7] * 3, 2),
             (350, [0.0] * d, 1), (400, [], 1), (401, [], 1), (402, [], 2), (-50, [-factor] * d, 1)]
    return [(*r, "x", 7, 8) for r in rows]


@pytest.mark.parametrize("factor", [1.0, 300.0, 1e6, 1e9, 1e30])
def test_odd_vectors(spark, factor):
    got = check(spark.createDataFrame(odd_rows(factor), SCHEMA).repartition(3), block_bytes=2000)
    assert len(got) > 300


def test_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(hn, "JOB_BLOCKS", 2)
    check(spark.createDataFrame(odd_rows(), SCHEMA), block_bytes=1000)


def test_no_rows(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.mine(spark.createDataFrame([(50, [1.0], 1, "", 1, 1)], SCHEMA)).collect() == []


@pytest.mark.parametrize("bits", [1, 4, 8, 12, 20, 26, 31, 60, 200])
def test_packed_products_are_exact(bits):
    rng = random.Random(bits)
    draw = lambda n, d: np.array([[rng.randrange(-2**bits, 2**bits) for _ in range(d)] for _ in range(n)], object if bits > 29 else np.int64)
    for n, d in ((1, 1), (7, 5), (50, 64)):
        rows, anchors = draw(n, d), draw(4, d)
        packed = hn.Packed(rows, int(anchors.min()), int(anchors.max()))
        assert packed.scores(anchors).tolist() == [[sum(int(p) * int(q) for p, q in zip(a, r, strict=True)) for r in rows] for a in anchors]
        assert packed.double == (packed.width <= hn.WIDE)


def test_negative_and_constant_components():
    rows, anchors = np.full((3, 4), -1000), np.full((2, 4), 2**20)
    assert hn.Packed(rows, 2**20, 2**20).scores(anchors).tolist() == [[-4000 * 2**20] * 3] * 2
