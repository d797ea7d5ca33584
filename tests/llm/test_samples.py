"""op9 and op7 on rows without ids; op9's EM against a plain one over documents."""
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mixing, weak_labels

SF01 = "/root/testdata/sf0.01"


def test_rows_without_ids_are_sampled_by_text(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", "quality")
    known = docs.join(labels, "doc_id").select(F.lit(None).cast("long").alias("doc_id"), "text", "quality")
    scored = weak_labels.classify(docs.withColumn("doc_id", F.lit(None).cast("long")), train_rows=300)
    assert scored.count() == docs.count()
    kept = scored.agg(F.avg(F.col("kept").cast("double"))).first()[0]
    good = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    assert abs(kept - good) < 0.1
    again = weak_labels.classify(docs.withColumn("doc_id", F.lit(None).cast("long")).repartition(5), train_rows=300)
    seen = lambda df: Counter((r.n_votes, round(r.posterior, 9), r.kept) for r in df.collect())
    assert sum((seen(scored) - seen(again)).values()) <= 5  # the same sample; the fit sums in another order


def test_nothing_to_fit_gives_posteriors(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for r in weak_labels.classify(docs, train_rows=0).collect():  # an empty sample
        assert r.score == r.posterior and r.kept == (r.posterior >= 0.2)
    same = spark.createDataFrame([(i, "Plain words of one text. " * 20) for i in range(30)], "doc_id long, text string")
    assert len({r.score for r in weak_labels.classify(same).collect()}) == 1


def test_whole_words_count():
    a, b = ("x1" * 40 + tail for tail in ("y" * 5, "-" * 5 + "Q"))
    assert weak_labels.Features()(a) != weak_labels.Features()(b)


def test_em_equals_a_plain_one():
    rng = random.Random(4)
    docs = [tuple(rng.choice([-1, 0, 0, 1]) if (good := rng.random() < 0.7) or not good else 0 for _ in range(3)) for _ in range(300)]
    prob, share = weak_labels.fit_labellers(Counter(docs), rounds=25, tol=0.0)
    p = [[{-1: 0.3, 0: 0.5, 1: 0.2}, {-1: 0.05, 0: 0.5, 1: 0.45}] for _ in range(3)]
    good = 0.8
    for _ in range(25):
        post = []
        for v in docs:
            one, zero = good, 1 - good
            for k in range(3):
                one, zero = one * p[k][1][v[k]], zero * p[k][0][v[k]]
            post.append(one / (one + zero))
        good = sum(post) / len(docs)
        p = [[{x: ((sum((w if c else 1 - w) for w, v in zip(post, docs, strict=True) if v[k] == x)) + 1) /
               (sum((w if c else 1 - w) for w in post) + 3) for x in (-1, 0, 1)} for c in (0, 1)] for k in range(3)]
    assert math.isclose(share, good, rel_tol=1e-6)
    np.testing.assert_allclose(prob, [[[p[k][c][x] for x in (-1, 0, 1)] for c in (0, 1)] for k in range(3)], rtol=1e-5)


def test_targets_are_met_without_ids(spark):
    rng = random.Random(6)
    rows = [(None if i % 3 else i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(20, 180))), f"s{i % 2}") for i in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 200
    assert got.where("taken > 2 * size").isEmpty()
