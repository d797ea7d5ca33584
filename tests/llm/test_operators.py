"""Every operator against a brute-force version, and on NULLs, empty and long texts, ties, repeats, empty tables, extra columns."""
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import bwt, html_text, licenses, mixing, near_vectors, pieces, quality_rules, simhash, suffix_dedup, warc, weak_labels
from tessera.llm.common import components, shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, block string"
SF = "/root/testdata/sf0.001"


def odd_rows():
    """NULLs in every column, empty, long, tied and repeated texts; columns with clashing names."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(300)}" for _ in range(3000)]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", " ", "\n\n", "é" * 10, "a", "b a b", " ".join(words), " ".join(words[:400]) + " " + passage,
             passage + " tail", passage, "x" * 5000, "x" * 4999, " ".join(words), "Released under the MIT License."]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "k", "z", "b") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, passage, None, None, None, None, None, None), (3, "another text of id three", None, "s0", 1, "", "", "")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1: licences

def test_license_base_matches_brute_force(spark, odd):
    def expect(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, v) for k, v in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(k.split())] == k.split()]
        return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at})))
    for docs in (odd, small_docs(spark)):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
        assert got == Counter((r.doc_id, *expect(r.text)) for r in docs.select("doc_id", "text").collect())


def test_license_notices_and_score(spark):
    notice = next(t for label, t, _ in licenses.NOTICES if label == "bsd")
    docs = spark.createDataFrame([(1, "intro words. " + notice), (2, notice.replace("binary forms", "binary")), (3, "of the the")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "bsd" and got[1].score == 1.0 and got[1].n_base == 0
    assert got[2].labels == "" and got[3].labels == ""


def test_license_empty(none):
    assert licenses.scan(none).collect() == []


# 2: quality

def test_quality_statistics_match_brute_force(spark, odd):
    def expect(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        twice = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 700 else None
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), None if twice is None else len(twice))
    for docs in (odd, small_docs(spark)):
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines): r for r in quality_rules.quality_rules(docs).collect()}
        for r in docs.collect():
            n, chars, symbols, dups, rep = expect(r.text)
            g = got[r.doc_id, n, chars, symbols, dups]
            assert rep is None or g.n_repeat_words == rep
            assert g.base_failed == (n < 10 or 100 * g.n_repeat_words > 20 * n)
            assert not (g.base_failed and g.kept)


def test_quality_rejects_outliers_in_a_hot_group(spark):
    rng = random.Random(3)
    good = [(i, " ".join("word" + "x" * rng.randrange(3) + str(rng.randrange(999)) for _ in range(80)), "en", "hot") for i in range(600)]
    junk = [(1000 + i, " ".join(f"w{k}%%%" for k in range(80)), "en", "hot") for i in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i] for i in range(600)) and not any(got[1000 + i] for i in range(60))


@pytest.mark.parametrize("copied", [True, False])
def test_quality_rejects_junk_that_is_a_third_of_its_group(spark, copied):
    rng = random.Random(5)
    good = [(i, " ".join("word" + "x" * rng.randrange(3) + str(rng.randrange(999)) for _ in range(80)), "en", "hot") for i in range(600)]
    junk = [(1000 + i, " ".join(f"w{k}" + "%" * (3 if copied else 2 + rng.randrange(3)) for k in range(80)), "en", "hot") for i in range(300)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i] for i in range(600)) and not any(got[1000 + i] for i in range(300))


def test_quality_judges_small_groups(spark):
    rng = random.Random(6)
    text = lambda: " ".join("word" + "x" * rng.randrange(3) + str(rng.randrange(999)) for _ in range(80))
    good = [(i, text(), "en", "large") for i in range(400)]
    rare = [(1000 + i, text(), None if i % 2 else "xx", None if i % 3 else f"t{i % 5}") for i in range(140)]
    junk = [(2000 + i, " ".join(f"w{k}%%%" for k in range(80 + i)), "xx", f"t{i % 5}") for i in range(10)]
    docs = spark.createDataFrame(good + rare + junk, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(r.distance is not None for r in got.values())
    assert {d for d, r in got.items() if not r.kept} == {d for d, *_ in junk}


def test_quality_starts_find_the_smallest_determinant():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 2000, (60, 5)), rng.normal(30000, 2000, (40, 5))])
    found = quality_rules.starts(x, 0.5)
    assert all(np.abs(found[0][0]) < 2000)


def test_quality_empty(none):
    assert quality_rules.quality_rules(none).collect() == []


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


# 3: SentencePiece

@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.MODEL)


def test_pieces_equal_the_library(model):
    rng = random.Random(11)
    alphabet = "abt he\n  ▁é語😀in er the0"
    for s in ["", " ", "a" * 50, "in" * 30, "0" * 9, " " * 40 + "x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]:
        assert model.encode(s) == model.sp.encode(s)


def test_compatible_is_the_merges_own_answer(model):
    rng = random.Random(2)
    for a, b in [rng.sample(list(model.ids), 2) for _ in range(3000)]:
        if model.merged(a) == [a] and model.merged(b) == [b]:
            assert model._compatible(a, b) == (model.merged(a + b) == [a, b])


def test_scan_over_chunks_equals_the_library(spark, model, odd):
    rows = [r for r in odd.collect()] + [r for r in small_docs(spark).collect()]
    for docs in (odd, small_docs(spark)):
        got = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in pieces.encode_documents(docs, chunk=100, fan=3).collect())
        assert got == Counter((r.doc_id, tuple(x := model.sp.encode(r.text or "")), len(x)) for r in docs.select("doc_id", "text").collect())
    assert rows
    assert all(r.round_trip for r in pieces.encode_documents(small_docs(spark), chunk=100, fan=3).collect())


def test_decode_documents(spark, odd):
    tokens = pieces.encode_documents(odd)
    got = Counter((r.doc_id, r.text) for r in pieces.decode_documents(tokens).collect())
    assert got == Counter((r.doc_id, r.text or "") for r in odd.collect())


def test_pieces_empty(none):
    assert pieces.encode_documents(none).collect() == []


# 4: vectors

def brute_vectors(rows, cosine=0.98):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(v)
    units = [(r[0], unit(r[1]), r[2]) for r in rows]
    links = [[j for j, (_, v, b) in enumerate(units) if j != i and a is not None and a == b and u is not None and v is not None
              and len(u) == len(v) and u @ v >= cosine] for i, (_, u, a) in enumerate(units)]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(len(rows))]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    return Counter((rows[i][0], len(links[i]), least[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("dense", [8192, 8])
def test_vectors_match_brute_force(spark, dense):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    vecs = [(base[i % 12] + rng.normal(size=16) * 0.08 * (i % 4)).tolist() for i in range(150)]
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)] + [(200 + i, vecs[0], 0) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, vecs[0], None), (304, [1.0, None] * 8, 0),
             (305, vecs[0][:8], 0), (306, [2 * x for x in vecs[0]], 0), (None, vecs[1], 1), (5, vecs[5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS links", "'x' AS key")
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(df, dense=dense).collect())
    assert got == brute_vectors(exact)


def test_vector_recall_on_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect())
    assert got == brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_vectors_empty(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# 5: WARC

def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300000), (6, "v", "y"),
            (6, "v", "y"), (None, "w", "y"), (None, None, "only")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, top string")
    folder = shared_folder(spark, "warc-test")
    index = warc.write_warc(warc.decide(pages), folder)
    assert index.count() == len(rows)
    got = warc.read_warc(index, folder, gap=10, most=1000).collect()
    sha = lambda t: __import__("base64").b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {t or "": max((r[0] for r in rows if (r[2] or "") == (t or "") and r[0] is not None), default=None) for _, _, t in rows}
    expect = Counter()
    for i, _, t in rows:
        response = i == top[t or ""]
        expect[i, len((t or "").encode()), sha(t), "response" if response else "revisit", None if response else top[t or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expect
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}[5] == "x" * 300000
    one = warc.read_warc(index.where("page_id = 5"), folder).collect()
    assert len(one) == 1 and one[0].payload_bytes == 300000
    assert warc.read_warc(warc.write_warc(warc.decide(pages.limit(0)), shared_folder(spark, "warc-none")), folder).collect() == []


def test_warc_read_tasks_and_folders(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 50) for i in range(200)], "page_id long, url string, html string")
    plain = shared_folder(spark, "warc-tasks").removeprefix("file://").removeprefix("file:")
    index = warc.write_warc(warc.decide(pages), plain)
    assert warc.qualified(spark, plain) == warc.qualified(spark, f"file://{plain}") == f"file:{plain}"
    got = warc.read_warc(index, f"file:{plain}", most=1000)
    assert sorted(r.page_id for r in got.collect()) == list(range(200))
    tasks = got.rdd.getNumPartitions()
    monkeypatch.setattr(warc, "TASK_BYTES", 500)
    size = sum(r["length"] for r in index.collect())
    assert warc.read_warc(index, plain).rdd.getNumPartitions() == -(-size // 500) > tasks


def test_warc_small_payloads_stay(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert [r.top for r in warc.decide(pages, min_bytes=3).collect()] == [None, None]


# 6: suffixes

def brute_suffix(rows):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                seen[b[i:i + 50]] = min(d, seen.get(b[i:i + 50], d))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and seen[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\x01" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def suffix_rows(df, **kw):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, **kw).collect())


def test_suffix_matches_brute_force(spark, odd):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(4000))
    rows = []
    for i in range(60):
        a = rng.randrange(3800)
        rows.append((rng.randrange(40), "".join(rng.choice("abcdé") for _ in range(rng.randrange(80))) + base[a:a + rng.randrange(30, 200)]
                     + rng.choice(["", "ab" * 40, base[5:60]])))
    rows += [(99, "ab" * 400), (98, "ab" * 30), (97, "ab" * 24 + "a"), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_rows(df, block_bytes=1000) == brute_suffix(rows)
    assert suffix_rows(odd, block_bytes=2000) == brute_suffix([(r.doc_id, r.text) for r in odd.collect()])


def test_suffix_large_families(spark):
    """One string of 20 bytes with other surroundings in a third of the texts; some surroundings repeat in part."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    hot = "Signed on behalf of:"
    heads, tails = [word(45) for _ in range(6)], [word(45) for _ in range(6)]
    rows = []
    for i in range(240):
        text = word(rng.randrange(60, 120))
        if i % 3 == 0:
            text = word(30) + rng.choice([*heads, word(45)]) + hot + rng.choice([*tails, word(45)]) + word(30)
        rows.append((rng.randrange(200), text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_suffix(rows)
    assert sum(r[2] > 0 for r in want) > 20
    for family in (1, 8, suffix_dedup.FAMILY):
        assert suffix_rows(df, block_bytes=2000, family=family) == want


def test_large_families_leave_their_mark(spark):
    """A large family's passages are dealt by the strings around the mark, others by the mark."""
    import pandas as pd
    import zstandard
    texts = [f"{i:040d}".encode() + b"Signed on behalf of:" + f"{i:040d}".encode() for i in range(50)]
    row = {"data": zstandard.compress(b"".join(texts)), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(),
           "ids": np.arange(50, dtype=np.int64).tobytes(), "known": np.ones(50, bool).tobytes()}
    x = suffix_dedup.Block(row)
    asked = lambda what: pd.DataFrame({"what": [what], "data": [np.sort(x.content).tobytes()]})
    pick, key = suffix_dedup._dealt(x, asked("ask"))
    assert len(pick) == len(x.pick) and (key == x.mark[pick]).all()
    pick, key = suffix_dedup._dealt(x, asked("split"))
    assert set(pick.tolist()) == set(x.pick.tolist()) and len(pick) <= 3 * len(x.pick)
    assert len(np.unique(key)) > len(np.unique(x.mark))


def test_common_line_stays_out_of_the_merge():
    """The strings around the mark of a line that all texts hold are as frequent as the mark: its windows are dealt one by one."""
    import pandas as pd
    import pyarrow as pa
    import zstandard
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90)).encode()
    texts = [f"{i:045d}".encode() + line + f"{i // 2:045d}".encode() for i in range(400)]
    blocks = []
    for k in range(4):
        part = texts[k::4]
        blocks.append({"block": k, "data": zstandard.compress(b"".join(part)), "sizes": np.array([len(t) for t in part], np.int64).tobytes(),
                       "ids": np.arange(k, 400, 4).astype(np.int64).tobytes(), "known": np.ones(100, bool).tobytes()})
    batch = lambda rows, s: pa.RecordBatch.from_pylist(rows, s)
    seen = [b for r in blocks for b in suffix_dedup._seen(1)(iter([pa.RecordBatch.from_pylist([r])]))]
    decided = pd.concat([b.to_pandas() for b in suffix_dedup._decisions(iter(seen), 20)])
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in suffix_dedup.SHARD.split(", "))])
    shards = []
    for r in blocks:
        asked = decided[(decided["block"] == r["block"]) & (decided["what"] != "whole")]
        shards += suffix_dedup._shards(1)(pd.DataFrame([r]), asked).to_dict("records")
    keys = Counter(k for r in shards if r["sizes"] for k in np.frombuffer(r["marks"], np.uint64).tolist())
    assert max(keys.values(), default=0) <= 20 * 2  # passages that are merged together
    rows = Counter(w for r in shards if not r["sizes"] for w in np.frombuffer(r["marks"], np.uint64).tolist())
    assert rows and max(rows.values()) <= len(blocks)  # a window is one row per block
    parts = pd.concat([b.to_pandas() for b in suffix_dedup._merged(iter([batch(shards, schema)]))])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = Counter()
    for r in blocks:
        mine = pd.concat([decided[decided["what"].isin(["whole", "each"])], parts])
        frame = suffix_dedup._removed([], False, names)(pd.DataFrame([r]), mine[mine["block"] == r["block"]])
        got.update(tuple(x) for x in frame.itertuples(index=False))
    assert got == brute_suffix([(i, t.decode()) for i, t in enumerate(texts)])


def test_suffix_carries_columns(spark, odd):
    got = suffix_dedup.suffix_dedup(odd, carry=["lang", "size"], with_text=True).collect()
    assert Counter((r.doc_id, r.x_lang, r.x_size) for r in got) == Counter((r.doc_id, r.lang, r["size"]) for r in odd.collect())
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_empty(none):
    assert suffix_dedup.suffix_dedup(none).collect() == []


def test_bwt_merge_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(100):
        depth, shards, suffixes = rng.choice([3, 5, 8]), [], []
        for _ in range(rng.randint(1, 4)):
            strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 5))]
            shards.append(bwt.shard(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])))
            every = [x[i:] for x in strings for i in range(len(x) + 1)]
            suffixes += [every[i] for i in shards[-1].place]
        order, lcp = bwt.merge(shards, depth)
        ordered = [suffixes[j][:depth] for j in order]
        assert ordered == sorted(ordered)
        cuts = [*bwt.repeated(lcp, depth), len(order)]
        got = Counter({ordered[a]: b - a for a, b in itertools.pairwise(cuts) if b - a > 1})
        assert got == Counter({k: v for k, v in Counter(x[:depth] for x in suffixes if len(x) >= depth).items() if v > 1})


# 7: mixing

def test_mixing_meets_targets_and_limits(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "tiny"])) for i in range(4000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    got = mixing.mix(df).collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(t.split()) for i, t, _ in rows}
    by = {}
    for r in got:
        by[r.target, r.source_size] = by.get((r.target, r.source_size), 0) + r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    total = sum(size for _, size in by)
    assert len(by) == 5 and abs(sum(t for t, _ in by) - 1.5 * total) < 1e-6 * total
    for (target, size), taken in by.items():
        assert target <= 2 * size and abs(taken - target) <= 60
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)


def test_mixing_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none).collect() == []


# 8: SimHash

def brute_simhash(rows):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(len(rows))]
    while True:
        new = [min(comp[j] for j in near[i]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    return Counter((rows[i][0], f"{fps[i]:016x}", least[comp[i]]) for i in range(len(rows)))


def test_simhash_matches_brute_force(spark, odd):
    for docs in (odd, small_docs(spark)):
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs).collect())
        assert got == brute_simhash([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("dense", [20000, 3])
def test_covering_finds_every_pair(spark, dense):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    comp = {r.node: r.root for r in components(simhash.links(df, 2, dense), "t").collect()}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            assert comp[simhash.signed(a)] == comp[simhash.signed(b)]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    groups = Counter(root)
    assert sorted(v for v in Counter(comp.values()).values()) == sorted(v for v in groups.values() if v > 1)


def test_simhash_empty(none):
    assert simhash.simhash_dedup(none).collect() == []


def test_components_of_a_long_chain(spark):
    df = spark.range(500).selectExpr("id AS a", "id + 1 AS b")
    roots = components(df, "chain").collect()
    assert len(roots) == 501 and len({r.root for r in roots}) == 1


# 9: weak labels

def test_weak_labels_on_held_out_truth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_labels.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_weak_labels_odd_rows(odd, none):
    got = weak_labels.classify(odd)
    assert got.count() == odd.count() and got.where("score < 0 OR score > 1").count() == 0
    assert weak_labels.classify(none).collect() == []


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    votes = np.stack([np.where(rng.random(20000) < 0.3, 0, np.where((rng.random(20000) < acc) == truth, 1, -1)) for acc in (0.9, 0.8, 0.75, 0.85)], axis=1)
    prob, good = weak_labels.fit_labellers(Counter(map(tuple, votes.tolist())))
    assert abs(good - 0.7) < 0.05 and abs(prob[0, 1, 2] / (prob[0, 1, 2] + prob[0, 1, 0]) - 0.9) < 0.05


# 10: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> Site</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside>Side text that is long enough to look like something worth reading</aside><form><p>Sign up<input></form>
<section id="comments"><article><p>A reader says a lot of things here, at length.</p></article></section><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div id='content'>%s</div>"])
def test_main_text_without_the_rest(wrap):
    body = "<h1>Head &amp; line</h1><p>First <b>bo</b>ld\n  paragraph with quite some text in it.<div class=ad>BUY</div><p>Second&nbsp;one, also long enough.</p><p>End.</p>"
    got = html_text.main_text(PAGE % (wrap % body))
    assert got == "Head & line\nFirst bold paragraph with quite some text in it.\nSecond one, also long enough.\nEnd."


def test_text_outside_the_marks():
    story = [f"Paragraph {i} of the story, which is long enough to be read and stands in a plain element of the page." for i in range(8)]
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3><p>Teaser {i}.</p></article>" for i in range(4))
    body = "<div class=body>" + "".join(f"<p>{x}</p>" for x in story) + "</div>"
    assert html_text.main_text(PAGE % (body + cards)) == html_text.main_text(PAGE % (cards + body)) == "\n".join(story)
    # an article of its own weight still bounds the text
    assert html_text.main_text(PAGE % f"<p>A line beside the article.</p><article>{body}</article><div>Another line beside it, with some text.</div>") == "\n".join(story)


def test_text_behind_a_sidebar_goes_on():
    story = [f"Paragraph {i} of the story, which is long enough to be read and stands in a plain element of the page." for i in range(8)]
    body = "<div>" + "".join(f"<p>{x}</p>" for x in story) + "<aside>Aside</aside><p>The last words.</p></div><nav>Menu</nav><p>Far away.</p>"
    assert html_text.main_text(PAGE % body) == "\n".join([*story, "The last words."])


def test_articles_of_the_pages(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in pages:
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", body))
        assert got[r.page_id].text == "\n".join(x for x in blocks if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a<p>b<script>x"), (3, "u", "plain  text"), (3, "u", "plain  text"), (4, "u", "<!-- open"),
            (5, "u", "<p>" + "long " * 50000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got == Counter([(1, ""), (2, ""), (None, "a\nb"), (3, "plain text"), (3, "plain text"), (4, ""), (5, ("long " * 50000).strip())])
    assert html_text.extract(df.limit(0)).collect() == []


def test_simhash_runs_its_rounds_once(spark, odd):
    """The two joins behind the components read stored classes, not the chain of rounds."""
    plan = simhash.simhash_dedup(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
