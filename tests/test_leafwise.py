"""Boosted trees grown best leaf first: against a plain greedy version on the driver."""
import json
import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import leafwise as LW
from tessera.operators import learners as L


def plain_booster(xs, ys, ws, edges, trees, leaves, depth, alpha, lam, rate, min_rows):
    """One split after another on Python lists; returns the margins."""
    n, width = len(xs), len(edges)
    bins = [[-1 if x[f] is None or math.isnan(x[f]) else sum(e <= x[f] for e in edges[f]) for f in range(width)] for x in xs]
    pos = sum(w for w, y in zip(ws, ys) if y)
    m = [math.log(pos / (sum(ws) - pos))] * n
    t = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    sc = lambda g, h: t(g) ** 2 / (h + lam)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in m]
        g = [w * (q - y) for w, q, y in zip(ws, p, ys)]
        h = [w * q * (1 - q) for w, q in zip(ws, p)]

        def best(rows):
            found = None
            G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
            for f in range(width):
                for b in range(-1, len(edges[f])):
                    left = [i for i in rows if bins[i][f] <= b]
                    if min(len(left), len(rows) - len(left)) < min_rows:
                        continue
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = sc(gl, hl) + sc(G - gl, H - hl) - sc(G, H)
                    if gain > 1e-12 and (found is None or round(gain / H, 10) > round(found[0] / H, 10)):
                        found = (gain, f, b)
            return found
        open_, closed = [(list(range(n)), 0)], []
        gains = [best(open_[0][0])]
        while len(open_) + len(closed) < leaves and any(gains):
            k = max((k for k, s in enumerate(gains) if s), key=lambda k: gains[k][0])
            rows, d = open_.pop(k)
            _, f, b = gains.pop(k)
            for part in ([i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]):
                open_.append((part, d + 1))
                gains.append(best(part) if depth < 0 or d + 1 < depth else None)
        for rows, _ in open_ + closed:
            v = -rate * t(sum(g[i] for i in rows)) / (sum(h[i] for i in rows) + lam)
            for i in rows:
                m[i] += v
    return m


def rows_of(spark, n=4):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = F.transform(F.slice("embedding", 1, n), lambda v, i: F.when((i == 2) & (F.pmod("vec_id", F.lit(5)) == 0), F.lit(float("nan"))).otherwise(v.cast("double")))
    return e.select(F.col("vec_id").alias("row_id"), array_to_vector(x).alias("features"), (F.col("label") < 3).cast("double").alias("label"))


@pytest.mark.parametrize("leaves,depth", [(6, -1), (64, 3)])
def test_equals_plain_greedy_growth(spark, leaves, depth):
    d = L.class_weights(rows_of(spark)).orderBy("row_id")
    est = LW.LeafwiseBooster(weightCol="weight", maxIter=7, stepSize=0.3, numLeaves=leaves, maxDepth=depth, maxBins=8, leafL1=0.3, leafL2=2.0, minRows=5)
    model = est.fit(d)
    rows = model.transform(d).select(vector_to_array("features").alias("x"), "label", "weight", vector_to_array("probability")[1].alias("p")).collect()
    flat = d.select(vector_to_array("features").alias("x"))
    edges = LW.quantile_edges(flat, 4, 8)
    want = plain_booster([r.x for r in rows], [r.label for r in rows], [r.weight for r in rows], edges, 7, leaves, depth, 0.3, 2.0, 0.3, 5)
    assert max(abs(1 / (1 + math.exp(-m)) - r.p) for m, r in zip(want, rows)) < 1e-9
    sizes = [sum(x < 0 for x in t["left"]) for t in model.nodes()]
    assert len(sizes) == 7 and max(sizes) <= leaves and (depth < 0 or max(len(t["steps"]) for t in model.nodes()) <= depth)


def test_leaf_penalties_shrink(spark):
    d = rows_of(spark)
    value = lambda **k: max(abs(v) for t in LW.LeafwiseBooster(maxIter=1, stepSize=1.0, numLeaves=4, maxBins=8, **k).fit(d).nodes() for v in t["value"])
    assert value() > value(leafL2=20.0) and value() > value(leafL1=5.0)
    assert LW.LeafwiseBooster(maxIter=2, leafL1=1e9).fit(d).nodes() == []


def test_saved_loaded_and_cross_fitted(spark, scratch):
    d = L.class_weights(rows_of(spark)).withColumn("fold", F.pmod("row_id", F.lit(2)).cast("int"))
    est = LW.LeafwiseBooster(weightCol="weight", maxIter=3, numLeaves=5, subsamplingRate=0.8, featureRate=0.5, positiveWeight=4.0)
    model = Pipeline(stages=[est]).fit(d)
    model.write().overwrite().save(f"{scratch}/m")
    again = PipelineModel.load(f"{scratch}/m")
    score = lambda m: {r.row_id: r.p for r in m.transform(d).select("row_id", vector_to_array("probability")[1].alias("p")).collect()}
    assert score(model) == score(again) and len(set(score(model).values())) > 3
    for t in model.stages[0].nodes():
        assert len({f for f in t["feature"] if f >= 0}) <= 2
    out = L.out_of_fold(d, {"leafwise": est})
    assert out.count() == d.count() and out.where("p IS NULL OR p < 0 OR p > 1").count() == 0


def test_odd_rows(spark):
    schema = "label double, features array<double>, probability string"
    make = lambda rows: spark.createDataFrame(rows, schema).withColumn("features", F.when(F.col("features").isNotNull(), array_to_vector("features")))
    empty = LW.LeafwiseBooster(maxIter=2).fit(make([]))
    assert empty.nodes() == [] and empty.getOrDefault("base") == 0.0
    one = LW.LeafwiseBooster(maxIter=2).fit(make([(1.0, [1.0], "a"), (1.0, [2.0], "b")]))
    assert one.nodes() == [] and one.getOrDefault("base") > 30
    rows = [(float(i % 2), [float(i % 2), 1.0], "z") for i in range(40)]
    rows += [(None, [9.0, 9.0], "z"), (1.0, None, "z"), (0.0, [float("inf"), float("nan")], "z"), (0.0, [float("-inf"), 0.0], "z")]
    df = make(rows)
    model = LW.LeafwiseBooster(maxIter=3, minRows=1, stepSize=0.5).fit(df)
    out = model.transform(df).select("label", F.col("features").isNull().alias("none"), F.when(F.col("features").isNotNull(), vector_to_array("probability")[1]).alias("p")).collect()
    assert [r.none for r in out if r.p is None] == [True]
    assert all((r.p > 0.5) == (r.label == 1.0) for r in out[:40])
    json.loads(model.getOrDefault("trees"))


def test_settings_of_the_learners(spark):
    d = L.class_weights(rows_of(spark))
    for name, est in L.penalised_learners().items():
        assert est.getOrDefault("maxIter") == {"XGBoost_Advanced": 500, "LightGBM": 400}[name]
        model = L.penalised_learners(scale=0.004)[name].fit(d)
        assert 1 <= len(model.nodes()) <= 2 and model.transform(d).where("probability IS NULL").count() == 0
