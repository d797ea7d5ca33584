"""Boosted trees grown best leaf first, with L1 and L2 terms on the leaves.

``LeafwiseBooster`` is an ML estimator over a vector column, for binary labels. Features are cut at
quantiles once. A tree is grown from histograms: gradients, curvatures and counts summed by (node,
feature, bin) in one DataFrame aggregation, whose map side already folds the rows, so what moves is
nodes x features x bins a task, whatever the rows. Running sums over the bins give every split's
gain, and only the best split of each node comes to the driver.

A node's gain does not depend on the other leaves. So the nodes that the best-first order may reach
next are summed together, a level in one job, and the tree has exactly the leaves of one split after
another: at most ``maxDepth`` jobs a tree in place of one a leaf.

NULL and NaN values lie below all others: they go left in every split.
"""

from __future__ import annotations

import heapq
import json
import math
import random
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

TREES = "array<struct<feature:array<int>,cut:array<double>,left:array<int>,right:array<int>,value:array<double>,steps:array<int>>>"
MISSING = -1  # bin of NULL and NaN


def shrunk(total, alpha: float):
    """The sum of gradients drawn towards 0 by the L1 term."""
    return F.signum(total) * F.greatest(F.abs(total) - F.lit(float(alpha)), F.lit(0.0))


def score(g, h, alpha: float, lam: float):
    """What a leaf with gradient sum ``g`` and curvature sum ``h`` takes off the loss, doubled."""
    t = shrunk(g, alpha)
    return F.when(h + F.lit(float(lam)) > 0, t * t / (h + F.lit(float(lam)))).otherwise(F.lit(0.0))


def histograms(rows: DataFrame, node: str = "node", bins: str = "bins", g: str = "g", h: str = "h") -> DataFrame:
    """(node, feature, bin, g, h, n): sums over the rows whose ``node`` is not NULL."""
    long = rows.where(F.col(node).isNotNull()).select(
        F.col(node).alias("node"), F.col(g).alias("g"), F.col(h).alias("h"), F.posexplode(bins).alias("feature", "bin"))
    return long.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def split_gains(hist: DataFrame, alpha: float = 0.0, lam: float = 0.0, min_rows: int = 1, min_weight: float = 0.0) -> DataFrame:
    """The gain of every cut (rows of ``bin`` and below go left): node, feature, bin, the sums on the
    left (gl, hl, nl) and of the node (g, h, n), gain. Cuts that leave a side with fewer than ``min_rows`` rows
    or ``min_weight`` curvature have no row."""
    part = Window.partitionBy("node", "feature")
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.select("node", "feature", "bin", *[F.sum(c).over(run).alias(f"{c}l") for c in ("g", "h", "n")],
                       *[F.sum(c).over(part).alias(c) for c in ("g", "h", "n")])
    gr, hr, nr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl"), F.col("n") - F.col("nl")
    fits = (F.least(F.col("nl"), nr) >= max(min_rows, 1)) & (F.least(F.col("hl"), hr) >= min_weight)
    gain = score(F.col("gl"), F.col("hl"), alpha, lam) + score(gr, hr, alpha, lam) - score(F.col("g"), F.col("h"), alpha, lam)
    return sums.where(fits).withColumn("gain", gain)


def best_splits(gains: DataFrame) -> DataFrame:
    """One row per node: the cut of the largest gain (ties: smallest feature, then bin). Gains that
    agree to ten places of the node's curvature are ties, so the order of summing decides nothing."""
    order = F.struct(F.round(F.col("gain") / F.greatest("h", F.lit(1e-300)), 10).alias("g"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return gains.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain", "gl", "hl", "nl", "g", "h", "n"), order).alias("s")).select("node", "s.*")


def walk(x, tree):
    """Number of the node of ``tree`` (a struct of arrays; ``steps`` is as long as the tree is deep)
    in which the array ``x`` ends."""
    def step(n, _):
        v = F.get(x, F.get(tree["feature"], n))
        goes_left = v.isNull() | F.isnan(v) | (v < F.get(tree["cut"], n))
        return F.when(F.get(tree["left"], n) < 0, n).when(goes_left, F.get(tree["left"], n)).otherwise(F.get(tree["right"], n))
    return F.aggregate(tree["steps"], F.lit(0), step)


def literal(trees: list):
    """``trees`` as one constant that the optimizer folds, however many there are."""
    return F.from_json(F.lit(json.dumps(trees)), TREES)


def margin(x, trees: list, base: float):
    """``base`` plus the values of the leaves in which ``x`` ends."""
    if not trees:
        return F.lit(float(base))
    return F.aggregate(literal(trees), F.lit(float(base)), lambda acc, t: acc + F.get(t["value"], walk(x, t)))


class _Tree:
    """A tree while it grows: nodes by number, the root is 0."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0.0], [-1], [-1], [0.0]
        self.depth, self.best = [0], {}

    def split(self, n: int, feature: int, cut: float) -> None:
        self.feature[n], self.cut[n] = feature, cut
        self.left[n], self.right[n] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for xs, empty in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                xs.append(empty)
            self.depth.append(self.depth[n] + 1)

    def arrays(self) -> dict:
        return {**{k: list(getattr(self, k)) for k in ("feature", "cut", "left", "right", "value")}, "steps": [0] * max(self.depth)}


def best_first(tree: _Tree, leaves: int, depth: int) -> tuple:
    """Which nodes the best-first order splits, as far as gains are known: (split nodes in order,
    nodes that it meets without a known gain)."""
    heap, order, unknown, count = [], [], [], 1

    def meet(n: int) -> None:
        if depth >= 0 and tree.depth[n] >= depth:
            return
        if n not in tree.best:
            unknown.append(n)
        elif tree.best[n] is not None and tree.best[n]["gain"] > 0:
            heapq.heappush(heap, (-float(f"{tree.best[n]['gain']:.10g}"), n))
    meet(0)
    while heap and count < leaves:
        _, n = heapq.heappop(heap)
        order.append(n)
        count += 1
        if count < leaves:
            meet(tree.left[n])
            meet(tree.right[n])
    return order, unknown


class _Params(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage of each tree", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth, -1 for none", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "largest number of leaves", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins a feature", TypeConverters.toInt)
    leafL1 = Param(Params._dummy(), "leafL1", "L1 term on leaf values", TypeConverters.toFloat)
    leafL2 = Param(Params._dummy(), "leafL2", "L2 term on leaf values", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "fewest rows in a leaf", TypeConverters.toInt)
    minCurvature = Param(Params._dummy(), "minCurvature", "least sum of curvature in a leaf", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a tree is grown on", TypeConverters.toFloat)
    featureRate = Param(Params._dummy(), "featureRate", "share of the features that a tree may use", TypeConverters.toFloat)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "factor on the weight of positive rows", TypeConverters.toFloat)


class LeafwiseBooster(_Params, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Binary log loss. Rows whose label or weight is NULL, or whose vector is, take no part in the
    fit. An empty table, or one of a single class, gives a model without trees."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, seed=42, maxIter=100, stepSize=0.1, maxDepth=-1,
                 numLeaves=31, maxBins=64, leafL1=0.0, leafL2=0.0, minRows=20, minCurvature=1e-3, subsamplingRate=1.0,
                 featureRate=1.0, positiveWeight=1.0):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        given = self._input_kwargs
        self._setDefault(**{k: v for k, v in dict(
            featuresCol="features", labelCol="label", seed=42, maxIter=100, stepSize=0.1, maxDepth=-1, numLeaves=31, maxBins=64, leafL1=0.0,
            leafL2=0.0, minRows=20, minCurvature=1e-3, subsamplingRate=1.0, featureRate=1.0, positiveWeight=1.0).items() if k not in given})

    def _fit(self, dataset: DataFrame) -> LeafwiseModel:
        p = lambda name: self.getOrDefault(name)
        spark = dataset.sparkSession
        folder = f"{ensure_checkpoint_dir(spark)}/leafwise-{uuid.uuid4().hex}"
        y, x = F.col(p("labelCol")).cast("double"), vector_to_array(F.col(p("featuresCol")))
        w = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        rows = dataset.where(F.col(p("featuresCol")).isNotNull()).select(x.alias("x"), y.alias("y"), (w * F.when(y > 0, F.lit(p("positiveWeight"))).otherwise(F.lit(1.0))).alias("w"))
        rows = rows.where("y IS NOT NULL AND w IS NOT NULL")
        total, positive, width = rows.agg(F.sum("w"), F.sum(F.when(F.col("y") > 0, F.col("w")).otherwise(0.0)), F.max(F.size("x"))).first()
        if not total or not 0 < positive < total:
            share = 0.5 if not total else min(max(positive / total, 1e-15), 1 - 1e-15)
            return self._model([], math.log(share / (1 - share)))
        base = math.log(positive / (total - positive))
        edges = quantile_edges(rows, width, p("maxBins"))
        kept = rows.select(binned("x", edges).alias("bins"), "y", "w", F.lit(base).alias("m"),
                           F.xxhash64("x", "y", F.monotonically_increasing_id()).alias("key"))
        stored = _Stored(kept, folder)
        trees, pending = [], []
        for k in range(p("maxIter")):
            grown = grow(stored.rows, pending, width, edges, rng=random.Random(f"{p('seed')}/{k}"), params=p)
            if grown is None:  # no cut has a gain on this tree's sample
                continue
            binwise, valuewise = grown
            trees.append(valuewise)
            pending.append(binwise)
            if len(pending) == _Stored.EVERY and k + 1 < p("maxIter"):
                stored.advance(pending)
                pending = []
        stored.drop()
        return self._model(trees, base)

    def _model(self, trees: list, base: float) -> LeafwiseModel:
        model = LeafwiseModel(trees=json.dumps(trees), base=base)
        return model._set(featuresCol=self.getOrDefault("featuresCol"))


class _Stored:
    """The binned rows with their margin, in the shared checkpoint folder. The margin is brought up to
    date every ``EVERY`` trees (trees in between are part of the plan); the older copy then goes."""

    EVERY = 5

    def __init__(self, rows: DataFrame, folder: str):
        self.spark, self.folder, self.version = rows.sparkSession, folder, 0
        self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        path = f"{self.folder}/{self.version}"
        rows.write.parquet(path)
        self.rows = self.spark.read.parquet(path)

    def advance(self, trees: list) -> None:
        rows = self.rows.withColumn("m", F.col("m") + margin(_doubles(), trees, 0.0))
        self.version += 1
        self._write(rows)
        self._remove(f"{self.folder}/{self.version - 1}")

    def drop(self) -> None:
        self._remove(self.folder)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _doubles():
    return F.transform("bins", lambda b: b.cast("double"))


def quantile_edges(rows: DataFrame, width: int, bins: int) -> list:
    """Per feature its distinct cuts: the values at the quantiles j / bins (a mergeable sketch of
    rank error under 1 / (100 * bins))."""
    probs = [j / bins for j in range(1, bins)]
    at = [F.percentile_approx(F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i))), probs, 100 * bins).alias(f"e{i}") for i in range(width)]
    found = rows.agg(*at).first()
    return [sorted(set(found[i] or [])) for i in range(width)]


def binned(x, edges: list):
    """Array of a bin number per feature: how many of its cuts are at or below the value. Where ``x``
    is shorter than the widest row, what lacks is a missing value."""
    cuts = F.from_json(F.lit(json.dumps(edges)), "array<array<double>>")

    def number(i):
        v = F.get(x, i)
        return F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).otherwise(F.size(F.filter(F.get(cuts, i), lambda e: e <= v))).cast("short")
    return F.transform(F.sequence(F.lit(0), F.lit(len(edges) - 1)), number)


def grow(rows: DataFrame, earlier: list, width: int, edges: list, rng: random.Random, params) -> tuple | None:
    """One tree on rows (bins, y, w, m, key), whose margin lacks the trees ``earlier``: (tree over
    bins, tree over values), or None if no cut has a gain."""
    p = params
    used = sorted(rng.sample(range(width), max(1, round(width * p("featureRate")))))
    salt = rng.getrandbits(31)
    x = _doubles()
    m = F.col("m") + margin(x, earlier, 0.0)
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
    if p("subsamplingRate") < 1:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 20)) < F.lit(int(p("subsamplingRate") * (1 << 20))))
    base = rows.select("bins", (F.col("w") * (prob - F.col("y"))).alias("g"), (F.col("w") * prob * (F.lit(1.0) - prob)).alias("h"))
    tree, sums = _Tree(), {}
    alpha, lam = p("leafL1"), p("leafL2")
    while True:
        order, unknown = best_first(tree, p("numLeaves"), p("maxDepth"))
        if not unknown:
            break
        at = F.lit(0) if tree.left[0] < 0 else walk(x, literal([tree.arrays()])[0])
        hist = histograms(base.select("bins", "g", "h", F.when(at.isin(unknown), at).alias("node")))
        if len(used) < width:
            hist = hist.where(F.col("feature").isin(used))
        found = {r["node"]: r.asDict() for r in best_splits(split_gains(hist, alpha, lam, p("minRows"), p("minCurvature"))).collect()}
        for n in unknown:
            tree.best[n] = s = found.get(n)
            if s is not None and s["gain"] > 0:
                tree.split(n, s["feature"], float(s["bin"] + 1))
                sums[n], sums[tree.left[n]] = (s["g"], s["h"]), (s["gl"], s["hl"])
                sums[tree.right[n]] = (s["g"] - s["gl"], s["h"] - s["hl"])
    if not order:
        return None
    return _only(tree, set(order), sums, edges, alpha, lam, p("stepSize"))


def _only(tree: _Tree, split: set, sums: dict, edges: list, alpha: float, lam: float, rate: float) -> tuple:
    """The tree with only the nodes of ``split`` split, over bins and over values, with leaf values."""
    out, queue, nodes, deepest = {k: [] for k in ("feature", "cut", "left", "right", "value")}, [0], 1, 0
    while queue:
        n = queue.pop(0)
        inner = n in split
        g, h = sums[n]
        leaf = -rate * math.copysign(max(abs(g) - alpha, 0.0), g) / (h + lam) if h + lam > 0 else 0.0
        row = (tree.feature[n], tree.cut[n], nodes, nodes + 1, 0.0) if inner else (-1, 0.0, -1, -1, leaf)
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
        if inner:
            queue += [tree.left[n], tree.right[n]]
            nodes, deepest = nodes + 2, max(deepest, tree.depth[n] + 1)
    out["steps"] = [0] * deepest
    cuts = []
    for f, c in zip(out["feature"], out["cut"], strict=True):  # a cut behind the missing values alone lies below every edge
        cuts.append(c if f < 0 else -math.inf if c < 1 else edges[f][int(c) - 1])
    return out, {**out, "cut": cuts}


class LeafwiseModel(HasFeaturesCol, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability``, a vector (P(0), P(1)); a NULL vector has NULL. Trees are kept as JSON."""

    trees = Param(Params._dummy(), "trees", "the trees, as JSON", TypeConverters.toString)
    base = Param(Params._dummy(), "base", "margin without trees", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, trees="[]", base=0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def nodes(self) -> list:
        return json.loads(self.getOrDefault("trees"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getOrDefault("featuresCol")))
        m = margin(x, self.nodes(), self.getOrDefault("base"))
        one = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
        known = F.col(self.getOrDefault("featuresCol")).isNotNull()
        return dataset.withColumn("probability", F.when(known, array_to_vector(F.array(F.lit(1.0) - one, one))))
