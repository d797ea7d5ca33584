"""Steps whose cost must not follow partitions or a task's rows: fits, ranks, top-k of wide rows, quartiles."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learners as L
from tessera.operators import meta, reports
from tessera.operators.ordering import narrowed_quantiles, parts_for, quantiles_by

NAN = float("nan")


def test_fits_use_few_partitions(spark):
    many = spark.range(1000).repartition(64)
    few = L.fit_rows(many)
    assert few.rdd.getNumPartitions() == 8 and few.count() == 1000 and few.distinct().count() == 1000
    assert L.fit_rows(many, most=50).rdd.getNumPartitions() == 20
    assert L.fit_rows(spark.range(10).coalesce(2)).rdd.getNumPartitions() <= 8


def test_forest_keeps_the_nodes_of_rows():
    assert L.base_learners(64)["RandomForest"].getCacheNodeIds()


def test_large_forest_is_fitted_in_groups(spark, monkeypatch):
    """Trees that would not fit in the driver together: groups of them score the held-out rows, and votes are added."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = rng.normal(size=3)
        rows.append((None if i == 7 else i // 2, [float(v) for v in x], float(x[0] + 0.3 * rng.normal() > 0), i % 2))
    df = spark.createDataFrame(rows, "row_id long, x array<double>, label double, fold int").withColumn("features", array_to_vector("x")).drop("x").coalesce(1)
    est = RandomForestClassifier(numTrees=30, maxDepth=3, minInstancesPerNode=5, weightCol="weight", seed=42)
    fits, fit = [], RandomForestClassifier.fit

    def counted(self, *a):
        model = fit(self, *a)
        fits.append((self.getNumTrees(), model.totalNumNodes))
        return model
    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    key = lambda d: sorted((r.row_id is None, r.row_id or 0, r.fold, r.label, r.p) for r in d.collect())
    whole = key(L.out_of_fold(df, {"RandomForest": est}, k=2))
    assert [t for t, _ in fits] == [30, 30] and all(n > 60 for _, n in fits)
    fits.clear()
    monkeypatch.setattr(L, "FOREST_NODES", 12, raising=False)
    groups = key(L.out_of_fold(df, {"RandomForest": est}, k=2))
    assert sum(t for t, _ in fits) == 60 and max(n for _, n in fits) <= 40 and len(fits) > 2 * 12
    assert [r[:4] for r in groups] == [r[:4] for r in whole]
    assert all(0 <= r[4] <= 1 for r in groups) and np.corrcoef([r[4] for r in groups], [r[4] for r in whole])[0, 1] > 0.9


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    assert parts_for(spark, 10) == 8 and parts_for(spark, 40_000_000) == 40
    monkeypatch.setattr(meta, "parts_for", lambda *a: 21)
    df = spark.createDataFrame([(i, (i * 7 % 50) / 50, (i * 3 % 10) / 10) for i in range(200)], "row_id long, a_pred double, b_pred double")
    ranks = meta.prediction_ranks(df, ["a_pred", "b_pred"])
    assert ranks.rdd.getNumPartitions() == 21
    rows = df.collect()
    want = {c: {r.row_id: i / 200 for i, r in enumerate(sorted(rows, key=lambda r: (r[f"{c}_pred"], r.row_id)))} for c in "ab"}
    assert all(r.a_rank == want["a"][r.row_id] and r.b_rank == want["b"][r.row_id] for r in ranks.collect())


def test_top_of_wide_rows_equals_top_of_all(spark):
    rows = [(1, 0.5, -0.5, 0.1, None, 0.0), (1, 0.5, 0.2, NAN, -0.3, -0.0), (2, None, None, None, None, 1.0),
            (3, math.inf, NAN, -math.inf, 2.0, 2.0), (4, 0.0, 0.0, 0.0, 0.0, 0.0), (5, None, None, None, None, None)]
    cols = ["e", "d", "c", "b", "a"]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols))
    for k in (1, 3, 5, 9):
        key = lambda t: sorted(map(str, map(tuple, t.collect())))  # noqa: E731, B023
        some = reports.row_top(df, "k", cols, "f", "v", k)
        assert key(reports.top_contributions(some, "k", "f", "v", k)) == \
            key(reports.top_contributions(df.unpivot(["k"], cols, "f", "v"), "k", "f", "v", k))
    assert reports.row_top(df.where("k = 3"), "k", cols, "f", "v", 3).count() == 3


def test_describe_finds_exact_quartiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    rows = [(float(v), float(i % 7), None if i % 3 else float(i), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, tied double, holes double, none double")
    got = {r.feature: r for r in meta.describe(df, df.columns).collect()}
    assert set(got) == {"x", "tied", "holes"}
    for i, c in enumerate(df.columns[:3]):
        v = np.array([r[i] for r in rows if r[i] is not None])
        assert [got[c].q25, got[c].q50, got[c].q75] == pytest.approx(np.quantile(v, [.25, .5, .75]), abs=1e-12)
        assert got[c]["count"] == len(v) and got[c]["std"] == pytest.approx(v.std(ddof=1))


def test_wrong_bounds_do_not_change_quantiles(spark):
    long = spark.createDataFrame([(g, float(i * i % 101)) for g in "ab" for i in range(300)] + [("a", NAN), ("b", None)], "g string, v double")
    n = long.where("v is not null").groupBy("g").agg(F.count("v").alias("n"))
    want = sorted(map(tuple, quantiles_by(long, ["g"], "v", [0.25, 0.9]).collect()))
    for ends in ((30.0, 31.0, 0.0, 200.0), (0.0, 101.0, 0.0, 101.0), (7.0, 1.0, 5.0, 5.0)):
        bounds = n.withColumns(dict(zip(("low0", "high0", "low1", "high1"), map(F.lit, ends))))
        assert sorted(map(tuple, narrowed_quantiles(long, "g", "v", [0.25, 0.9], bounds).collect())) == want
