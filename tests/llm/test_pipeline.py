"""The pipeline against a plain version of its stages, and on odd rows."""
from collections import Counter

import pytest
from test_operators import DOCS, brute_simhash, brute_suffix, odd_rows

import corpus_pipeline as cp
from tessera.llm import mixing, pieces, quality_rules

SF = "/root/testdata/sf0.001"


def test_run_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    comp = {d: c for d, _, c in brute_simhash(rows)}
    rows = [(d, t) for d, t in rows if comp[d] == d]
    by_id = {d: (n, gone) for d, n, gone, _, _ in brute_suffix(rows)}
    third = {r.doc_id: r for r in cp.suffix_stage(spark, spark.createDataFrame(
        [(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert {d: len(r.text.encode()) for d, r in third.items()} == {d: n - gone for d, (n, gone) in by_id.items()}
    kept = docs.where(docs.doc_id.isin(list(third))).collect()
    left = spark.createDataFrame([(r.doc_id, third[r.doc_id].text, r.lang, r.source, 0) for r in kept],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    times = {r.doc_id: r.repeats for r in mixing.mix(left).collect()}
    sp = pieces.Pieces(pieces.MODEL).sp
    expect = Counter()
    for d, n in times.items():
        if n:
            expect[d, tuple(sp.encode(third[d].text))] += n
    got = cp.run(spark, SF).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expect and all(r.round_trip for r in got)


def _shared_ids():
    import random
    rng = random.Random(8)
    text = lambda: " ".join("word" + "x" * rng.randrange(3) + str(rng.randrange(999)) for _ in range(80))
    return [(None if i % 2 else 7, text(), "en", f"s{i % 2}", 1, "k", "z", "b") for i in range(60)]


def test_quality_stage_judges_rows_that_share_an_id(spark):
    good = _shared_ids()
    junk = [(None, "a b c", "en", "s0", 1, "k", "z", "b"), (7, None, "en", "s1", 1, "k", "z", "b")]
    out = cp.quality_stage(spark, spark.createDataFrame(good + junk, DOCS), SF)
    assert Counter(r.text for r in out.collect()) == Counter(r[1] for r in good)


def test_simhash_stage_judges_rows_that_share_an_id(spark):
    rows = _shared_ids()
    null = [r for r in rows if r[0] is None]
    docs = [*null, (5, null[0][1], "en", "s0", 1, "k", "z", "b")]  # one NULL row is a copy of document 5
    out = cp.simhash_stage(spark, spark.createDataFrame(docs, DOCS), SF).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(5, null[0][1]), *((None, r[1]) for r in null[1:])])


def test_mixing_stage_judges_rows_that_share_an_id(spark):
    rows = [(i, f"w{i} " * 50, "en", s, 1, "k", "z", "b") for s in ("a", "b", "c") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    times = {(r.lang, r.doc_id): r.repeats for r in mixing.mix(docs.withColumn("lang", docs.source), carry=["lang"]).collect()}
    assert any(times["a", i] != times["b", i] for i in range(40))
    got = Counter((r.source, r.doc_id) for r in cp.mixing_stage(spark, docs, SF).collect())
    assert got == Counter({k: n for k, n in times.items() if n})


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[:-1]])
def test_stages_take_odd_rows_and_none(spark, stage):
    for rows in (odd_rows(), []):
        out = stage(spark, spark.createDataFrame(rows, DOCS), SF)
        assert out.columns == cp.COLUMNS
        assert out.count() <= 2 * len(rows)
