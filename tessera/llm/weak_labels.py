"""Quality classifier from a weak-label model.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of all vote patterns estimates each
labeller's accuracy on good and on bad documents and the share of good ones;
every pattern gets a posterior. Posterior labels train a linear scorer on
hashed features of the text, which then scores every document.

Scale: texts are read twice, once for votes and training features, once for
scores. Vote patterns are counted with pre-aggregation; their number is
bounded by 3^labellers whatever the input, in practice some hundreds, and
only they reach the driver. The scorer is fitted by Spark ML on a bounded
sample of about ``train_rows`` rows (those with the smallest hashes of id and
text, so reruns agree; equal rows are one with their number as weight); votes,
accuracies, posteriors and scores cover all.

Cases: NULL or empty text: the length labeller votes bad, the scorer sees its
intercept. Repeated rows and NULL ids are scored each. If the sample is empty
or its posteriors leave only one class, there is nothing to fit and every
document's score is its posterior. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import statistics

GOOD, BAD, ABSTAIN = 1, -1, 0
LABELLERS = ("length", "symbols", "repeats", "stutter", "dup_lines", "capitals", "exclaims", "sentences", "variety", "plain")
BUCKETS = 4096
TRAIN_ROWS = 20000


def votes(text: str | None) -> tuple[int, ...]:
    """One vote per labeller."""
    text = text or ""
    n, chars, symbols, dups, repeats, capitals = statistics(text)
    if n == 0:
        return (BAD,) + (ABSTAIN,) * (len(LABELLERS) - 1)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    bad = lambda x: BAD if x else ABSTAIN  # noqa: E731  # these find one fault each and know nothing of good texts
    marks = text.count("!")
    same = sum(map(str.__eq__, words, words[1:]))
    ended = sum(x.rstrip()[-1:] in ".!?\"'" for x in lines) / max(1, len(lines))
    variety = len(set(words)) / max(1, len(words)) * math.sqrt(max(1, len(words)) / 100)
    plain = symbols < 0.02 * n and repeats < 0.1 * n and same < 0.05 * n and capitals < 0.2 * chars and \
        marks < 0.05 * n and ended > 0.5 and 3.5 <= chars / n <= 7.5
    return (
        bad(n < 10),
        bad(symbols > 0.1 * n),
        bad(repeats > 0.2 * n),
        bad(same > 0.2 * n),
        bad(dups > 0.3 * len(lines)),
        bad(capitals > 0.3 * chars),
        bad(marks > 0.2 * n),
        bad(n >= 20 and ended < 0.3),
        bad(n >= 20 and variety < 0.1),
        GOOD if plain else ABSTAIN,
    )


def fit_labellers(patterns: dict[tuple[int, ...], int], rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """EM over vote patterns: (labellers, 2, 3) probabilities of bad/nothing/good given bad and given good, and the
    share of good documents. Starts from labellers that are right more often than not."""
    rows = np.array(list(patterns), int)
    weight = np.array(list(patterns.values()), float)
    prob = np.empty((rows.shape[1], 2, 3))
    prob[:, 0], prob[:, 1] = (0.3, 0.5, 0.2), (0.05, 0.5, 0.45)
    good, before = 0.8, -math.inf
    for _ in range(rounds):
        post, log_like = posterior(rows, prob, good)
        total = float(weight @ log_like)
        w1, w0 = weight * post, weight * (1 - post)
        good = min(max(w1.sum() / weight.sum(), 1e-6), 1 - 1e-6)
        for k in range(rows.shape[1]):
            for v in (-1, 0, 1):
                at = rows[:, k] == v
                prob[k, 0, v + 1] = (w0[at].sum() + 1) / (w0.sum() + 3)
                prob[k, 1, v + 1] = (w1[at].sum() + 1) / (w1.sum() + 3)
        if total - before < tol * abs(total):
            break
        before = total
    return prob, good


def posterior(rows: np.ndarray, prob: np.ndarray, good: float) -> tuple[np.ndarray, np.ndarray]:
    """P(good | votes) and the log likelihood of each row of votes."""
    k = np.arange(rows.shape[1])
    one = math.log(good) + np.log(prob[k, 1, rows + 1]).sum(axis=1)
    zero = math.log(1 - good) + np.log(prob[k, 0, rows + 1]).sum(axis=1)
    both = np.logaddexp(one, zero)
    return np.exp(one - both), both


_RUN = re.compile(r"(.)\1+", re.S)
_TO_SHAPE = {c: ("9" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" if chr(c).isalpha() else chr(c)) for c in range(0x250)}


class Features:
    """Hashed features of a text: its words' shapes (classes of characters, runs shortened), repeated words and
    word pairs, and length; by the logarithm of their share of the words."""

    def __init__(self) -> None:
        self.of_word: dict[str, int] = {}

    def __call__(self, text: str | None) -> dict[int, float]:
        words = (text or "").split()
        count: dict[int, int] = {}
        known, last = self.of_word, None
        pairs: set[tuple[str | None, str]] = set()
        again = 0
        if len(known) > 500_000:
            known.clear()
        for w in words:
            k = known.get(w)
            if k is None:
                shape = _RUN.sub(r"\1", w.translate(_TO_SHAPE))
                k = known[w] = zlib.crc32(shape.encode()) % BUCKETS
            count[k] = count.get(k, 0) + 1
            if w == last:
                again += 1
            pairs.add((last, w))
            last = w
        echo = len(words) - len(pairs)
        for name, n in ((b"again", again), (b"echo", echo)):
            if n:
                k = zlib.crc32(name) % BUCKETS
                count[k] = count.get(k, 0) + n
        out = {k: math.log1p(50 * v / len(words)) for k, v in count.items()}
        size = zlib.crc32(b"words %d" % min(12, len(words).bit_length())) % BUCKETS
        out[size] = out.get(size, 0) + 1.0
        return out


def _sparse(indices, values):
    return Vectors.sparse(BUCKETS, dict(zip(indices, values, strict=True)))


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.2) -> DataFrame:
    """One row per document: doc_id, n_votes, posterior (weak labels), score (scorer, 0 to 1), kept (score >= threshold)."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [votes(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int32()))], ["votes"])

    voted = docs.select("text").mapInArrow(vote, "votes array<int>")
    patterns = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return spark.createDataFrame([], f"doc_id {id_type}, n_votes int, posterior double, score double, kept boolean")
    prob, good = fit_labellers(patterns)
    post = posterior(np.array(list(patterns), int), prob, good)[0]
    of_pattern = {p: float(x) for p, x in zip(patterns, post, strict=True)}

    # the training sample: hashes below the share that leaves about train_rows
    fitted = _fit(docs, min(1.0, train_rows / sum(patterns.values())), of_pattern)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            v = [votes(t.as_py()) for t in b.column(1)]
            if fitted is None:
                s = np.array([of_pattern[r] for r in v], float)
            else:
                weights, bias = fitted
                x = [bias + sum(weights[k] * c for k, c in features(t.as_py()).items()) for t in b.column(1)]
                s = 1 / (1 + np.exp(-np.clip(np.array(x, float), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sum(y != 0 for y in r) for r in v], pa.int32()),
                 pa.array([of_pattern[r] for r in v], pa.float64()), pa.array(s), pa.array(s >= threshold)],
                ["doc_id", "n_votes", "posterior", "score", "kept"])
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {id_type}, n_votes int, posterior double, score double, kept boolean")


def row_hash(doc_id, text: str | None) -> int:
    """Unsigned 64-bit hash of a row."""
    return xxhash.xxh64_intdigest((text or "").encode(), zlib.crc32(str(doc_id).encode()))


def _fit(docs: DataFrame, share: float, of_pattern: dict) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of a logistic regression on posterior labels of the rows with the smallest ``share`` of
    hashes; None if they leave less than two classes."""
    below = int(share * 2 ** 64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            out: dict[str, list] = {"h": [], "indices": [], "values": [], "posterior": []}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = row_hash(i, t)
                if h < below:
                    f = features(t)
                    out["h"].append(h - (1 << 63))
                    out["indices"].append(sorted(f))
                    out["values"].append([f[k] for k in sorted(f)])
                    out["posterior"].append(of_pattern[votes(t)])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("indices", pa.list_(pa.int32())),
                                                             ("values", pa.list_(pa.float64())), ("posterior", pa.float64())]))
    rows = docs.select("doc_id", "text").mapInArrow(sample, "h long, indices array<int>, values array<double>, posterior double")
    rows = stored(rows.groupBy("h").agg(*[F.first(c).alias(c) for c in ("indices", "values", "posterior")],
                                        F.count(F.lit(1)).cast("double").alias("n")), "weak-sample")
    from pyspark.ml.linalg import VectorUDT
    vec = F.udf(_sparse, VectorUDT())
    both = rows.select(vec("indices", "values").alias("features"), "posterior", "n")
    soft = both.select("features", F.lit(1.0).alias("label"), (F.col("n") * F.col("posterior")).alias("weight")).unionByName(
        both.select("features", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("posterior"))).alias("weight"))).where("weight > 1e-6")
    if soft.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(maxIter=50, regParam=1e-5, standardization=False, weightCol="weight").fit(soft)
    return model.coefficients.toArray(), float(model.intercept)


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
