"""Quality rules with robust multivariate outliers (minimum covariance determinant).

Every document gets a vector of transformed statistics. Per language and
source the mean and covariance of the half of the distinct vectors with the
smallest covariance determinant are estimated. Starts are the medians and
random draws of a few vectors, tried on a sample of the group; the three best
are stepped over all its vectors (distances under the current estimate, the
nearest half, a new estimate from those) until the determinant stops falling,
and the smallest wins. It is then estimated once more from all vectors within
its 97.5 % quantile. A document is rejected if its Mahalanobis distance under
its group's estimate exceeds the cutoff, or by the base rule. A vector counts
once however many documents have it, so copies of one text cannot make up the
core; different junk breaks the estimate if it is about half of the vectors.

Scale: texts are read once; the steps run over a stored table of five small
integers per distinct vector. A step is one aggregation that Spark
pre-aggregates per task: distances fall into buckets of about 1 %, and each
(group, start, bucket) keeps a count and 20 sums, from which the border and
the new estimate follow; the bucket on the border counts with the share that
makes up the half. So a group with a third of all rows is never gathered; only
the sample of a group (about 512 vectors, by hash) is one task's. Statistics
are integers, so the sums do not depend on the order of rows. Estimates (one
row per group and start) are joined by (group, salt): Spark broadcasts them if
it measures them as small, else the salt splits a hot group.

A (language, source) with under ``min_rows`` (50) distinct vectors is judged by
the estimate of its whole language, its large sources included, and if that has
fewer too by the estimate of the whole table, whatever its size; so every
document is judged. NULL languages and sources are values of their own.

Cases: NULL text has no words and fails the base rule. Repeated rows and NULL
ids are returned as they are. An empty table gives no rows. Variances get a
floor, so groups of equal documents (ties) have an estimate too. Only doc_id,
text, lang and source are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
UNIT = 1024  # statistics are kept in 1/1024
#: Statistic and the least standard deviation it is given.
DIMS = {"word_length": 0.06, "symbols": 0.25, "dup_lines": 0.25, "repeats": 0.25, "capitals": 0.25}
P = len(DIMS)
SALT = 32
MIN_ROWS = 50  # distinct vectors
SAMPLE = 512  # distinct vectors of a group that the starts are sought in
DRAWS = 300
STARTS = 3
FALL = 1e-3  # of the logarithm of the determinant
REWEIGHT = 0.975


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that stand in the text twice or more."""
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    total, end = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            total += i + WINDOW - max(end, i)
            end = i + WINDOW
    return total


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ASCII capitals."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    seen: set[bytes] = set()
    dups = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dups += line in seen
            seen.add(line)
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dups, repeated_words(words), capitals


def vector(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, capitals: int) -> list[int]:
    """The transformed statistics in 1/UNIT. Fifty average words are added, so that short texts do not stand out by chance."""
    n = n_words + 50
    x = [math.log((word_chars + 250) / n), math.log1p(50 * n_symbols / n), math.log1p(50 * n_dup_lines / n),
         math.log1p(10 * n_repeat_words / n), math.log1p(10 * capitals / (word_chars + 250))]
    return [round(v * UNIT) for v in x]


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
Z = [f"z{i}" for i in range(P)]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, STATS and the vector z0..z4."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(3)]
            z = [vector(*s) for s in stats]
            cols = [pa.array([s[i] for s in stats], pa.int64()) for i in range(5)]
            cols += [pa.array([v[i] for v in z], pa.int64()) for i in range(P)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols],
                                             ["doc_id", "lang", "source", *(c.split()[0] for c in STATS.split(", ")), *Z])
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, source {kinds['source']}, {STATS}, " + ", ".join(f"{z} long" for z in Z))


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))


def _match(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join one row per key to each of its rows; keys are NULL-safe and split by the column ``salt``."""
    right = _salted(small.withColumnsRenamed({c: f"r_{c}" for c in on}))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in on])
    return big.join(right, same & (F.col("salt") == F.col("s")), how).drop("s", *[f"r_{c}" for c in on])


def _keys() -> list[Column]:
    """Names of the groups that a row is a member of: its source's, its language's, the whole table's."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return [F.concat(F.lit("source\t"), text("lang"), F.lit("\t"), text("source")), F.concat(F.lit("lang\t"), text("lang")), F.lit("all")]


def members(stats: DataFrame) -> DataFrame:
    """Each distinct vector of every group once, and salt: copies of a text do not outweigh the group's other documents."""
    return stats.select(F.explode(F.array(*_keys())).alias("grp"), *Z).distinct() \
        .withColumn("salt", F.pmod(F.xxhash64(*Z), F.lit(SALT)).cast("int"))


def judges(stats: DataFrame, points: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, grp): the smallest of a row's groups with ``min_rows`` distinct vectors, else the whole table."""
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("grp")
    source, lang, every = _keys()
    pairs = stats.select("lang", "source").distinct().withColumn("of_source", source).withColumn("of_lang", lang)
    return pairs.join(sizes.withColumnRenamed("grp", "by_source"), F.col("of_source") == F.col("by_source"), "left") \
        .join(sizes.withColumnRenamed("grp", "by_lang"), F.col("of_lang") == F.col("by_lang"), "left") \
        .select("lang", "source", F.coalesce("by_source", "by_lang", every).alias("grp"))


def chi2_cdf(x: float, df: int) -> float:
    """P(chi-square with df degrees <= x), by the series of the incomplete gamma function."""
    a, h = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= h / k
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and chi2_cdf(mid, df) < q else (low, mid)
    return high


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns mean (array) and inv (array, row by row)."""
    d = [F.col(z) - F.col("mean")[i] for i, z in enumerate(Z)]
    terms = [d[i] * d[j] * F.col("inv")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return reduce(lambda a, b: a + b, terms)


@lru_cache(maxsize=4096)
def consistency(share: float) -> float:
    """The covariance of the nearest ``share`` of normal vectors is too small by this factor."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, P), P + 2)


FLOOR = np.diag([(f * UNIT) ** 2 for f in DIMS.values()])


def core_size(n, alpha: float):
    """Vectors in the core of ``n``: at least ``alpha`` of them, and enough for a covariance (number or Column)."""
    if isinstance(n, Column):
        return F.least(n, F.greatest(F.ceil(alpha * n), F.floor((n + P + 1) / 2)))
    return min(n, max(math.ceil(alpha * n), (n + P + 1) // 2))


def _estimates(x: np.ndarray, means: np.ndarray, covs: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One concentration step for many estimates (mean, floored covariance) at once, with exactly ``h`` vectors, and log determinants."""
    d = x[None] - means[:, None]
    d2 = np.einsum("snp,snp->sn", d @ np.linalg.inv(covs), d)
    core = x[np.argsort(d2, axis=1, kind="stable")[:, :h]]
    means = core.mean(axis=1)
    c = core - means[:, None]
    covs = consistency(round(h / len(x), 3)) * np.einsum("snp,snq->spq", c, c) / h + FLOOR
    return means, covs, np.linalg.slogdet(covs)[1]


def starts(x: np.ndarray, alpha: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The estimates of smallest determinant in a sample, at most STARTS: from medians and from
    DRAWS draws of P + 1 vectors, two steps each, the ten best to the end."""
    x = x[np.lexsort(x.T[::-1])]  # whatever the order of rows
    h = core_size(len(x), alpha)
    rng = np.random.default_rng(2)
    middle = np.median(x, axis=0)
    draws = x[np.argsort(rng.random((DRAWS, len(x))), axis=1)[:, :P + 1]]
    c = draws - draws.mean(axis=1, keepdims=True)
    means = np.concatenate([middle[None], draws.mean(axis=1)])
    covs = np.concatenate([np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2)[None],
                           np.einsum("snp,snq->spq", c, c) / draws.shape[1]]) + FLOOR
    for _ in range(2):
        means, covs, det = _estimates(x, means, covs, h)
    best = np.argsort(det, kind="stable")[:10]
    means, covs, det = means[best], covs[best], det[best]
    while True:
        m, c, new = _estimates(x, means, covs, h)
        if not (new < det - FALL).any():
            break
        means, covs, det = m, c, new
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.argsort(det, kind="stable"):
        if len(out) < STARTS and not any(np.allclose(means[k], m) and np.allclose(covs[k], c) for m, c in out):
            out.append((means[k], covs[k]))
    return out


ESTIMATE = "grp string, start int, mean array<double>, inv array<double>, det double"


def _start(points: DataFrame, alpha: float) -> DataFrame:
    """First estimates of every group, from about SAMPLE of its points (all, if it has no more)."""
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("all"))
    place = F.pmod(F.xxhash64(F.lit(2), *Z), F.lit(1 << 30))
    sample = _match(points, sizes, ["grp"]).where((F.col("all") <= SAMPLE) | (place * F.col("all") < SAMPLE << 30))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = starts(f[Z].to_numpy(float), alpha)
        return pd.DataFrame([(f["grp"].iloc[0], k, m.tolist(), np.linalg.inv(c).ravel().tolist(), math.inf) for k, (m, c) in enumerate(found)],
                            columns=["grp", "start", "mean", "inv", "det"])
    return sample.select("grp", *Z).groupBy("grp").applyInPandas(run, ESTIMATE)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}_{j}" for i, j in PAIRS]]


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(z).cast("double")).alias(f"s{i}") for i, z in enumerate(Z)],
            *[F.sum((F.col(Z[i]) * F.col(Z[j])).cast("double")).alias(f"q{i}_{j}") for i, j in PAIRS]]


def _solve(core: DataFrame) -> DataFrame:
    """Estimates from rows (grp, start, share, SUMS)."""
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
                cov = consistency(round(r["share"], 3)) * cov + FLOOR
                out.append((r["grp"], r["start"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["grp", "start", "mean", "inv", "det"])
    return core.mapInPandas(solve, ESTIMATE)


def _step(points: DataFrame, estimate: DataFrame, alpha: float) -> DataFrame:
    """One concentration step: new estimates from the nearest ``core_size`` points of each group.

    Of the bucket on the border each point counts with the same share, so that the weights add up to the size."""
    bucket = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * 64).cast("int")
    near = _match(points, estimate, ["grp"]).withColumn("d2", _distance())
    sums = near.groupBy("grp", "start", bucket.alias("bucket")).agg(*_sums())
    group = Window.partitionBy("grp", "start")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    core = sums.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("all", F.sum("n").over(group)) \
        .withColumn("h", core_size(F.col("all"), alpha)).where("before < h") \
        .withColumn("part", F.least(F.lit(1.0), (F.col("h") - F.col("before")) / F.col("n")))
    return _solve(core.groupBy("grp", "start").agg((F.first("h") / F.first("all")).alias("share"),
                                                   *[F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS]))


def _smallest(points: DataFrame, alpha: float) -> DataFrame:
    """Per group the estimate of smallest determinant: every start is stepped until its determinant stops falling."""
    active = stored(_start(points, alpha), "quality-start")
    ended = []
    while not active.isEmpty():
        old = active.select("grp", "start", *[F.col(c).alias(f"old_{c}") for c in ("mean", "inv", "det")])
        both = stored(_step(points, active, alpha).join(old, ["grp", "start"]), "quality-step")
        falls = F.col("det") < F.col("old_det") - FALL
        worse = F.col("det") > F.col("old_det")
        ended.append(both.where(~falls).select("grp", "start", *[
            F.when(worse, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "inv", "det")]))
        active = both.where(falls).select(*active.columns)
    best = Window.partitionBy("grp").orderBy("det", "start")
    every = reduce(DataFrame.unionByName, ended) if ended else active
    return every.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def _reweighted(points: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate from all points within the REWEIGHT quantile of the first one."""
    near = _match(points, estimate, ["grp"]).where(_distance() <= chi2_quantile(REWEIGHT, P))
    return _solve(near.groupBy("grp", "start").agg(F.lit(REWEIGHT).alias("share"), *_sums()))


def quality_rules(docs: DataFrame, alpha: float = 0.5, tail: float = 1e-5, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per document: doc_id, STATS, base_failed, kept, distance (squared).

    The squared distance may be as large as the chi-square quantile that
    normal vectors exceed with probability ``tail``."""
    cutoff = chi2_quantile(1 - tail, P)
    stats = stored(document_statistics(docs), "quality-stats")
    every = stored(members(stats), "quality-members")
    groups = stored(judges(stats, every, min_rows), "quality-groups")
    points = stored(_match(every, groups.select("grp").distinct(), ["grp"]), "quality-points")
    estimate = stored(_reweighted(points, stored(_smallest(points, alpha), "quality-core")), "quality-estimate")
    names = [c.split()[0] for c in STATS.split(", ")]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    salted = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", *Z), F.lit(SALT)).cast("int"))
    rows = _match(salted, groups.join(estimate, "grp"), ["lang", "source"])
    out = rows.withColumn("distance", _distance()).withColumn("base_failed", failed)
    return out.select("doc_id", *names, "base_failed",
                      (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"), "distance")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
