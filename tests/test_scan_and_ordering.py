import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import PanelSpec
from tessera.operators import clean, temporal
from tessera.operators.ordering import ordinal_rank, prefix_sums, quantiles_by
from tessera.operators.scan import CUT, OPS, SEGMENT, entity_scan, place
from tessera.sources import fixtures as fx

from conftest import SF01

SPEC = PanelSpec()


def _plain(df, entity, order, c):
    """The scan's columns by one window per entity."""
    w = Window.partitionBy(entity).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    return df.select("*", F.last(c, ignorenulls=True).over(run).alias(f"{c}__ffill"),
                     F.first(c, ignorenulls=True).over(rest).alias(f"{c}__bfill"),
                     F.lag(c, 1).over(w).alias(f"{c}__lag1"), F.lag(c, 2).over(w).alias(f"{c}__lag2"),
                     F.max(c).over(run).alias(f"{c}__cummax"), F.min(c).over(run).alias(f"{c}__cummin"),
                     (F.row_number().over(w) - 1).cast("long").alias("__idx"),
                     F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("__n"))


SCANNED = [f"v__{o}" for o in OPS] + ["__idx", "__n"]


def _null_first(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def test_segmented_scan_equals_plain_window_on_panel(spark):
    p = fx.panel(spark, SF01).withColumnRenamed("hr", "v")
    a = _plain(p, "patient_id", ["hour", "event_id"], "v")
    key = ["patient_id", "hour", *SCANNED]
    want = _null_first(tuple(r) for r in a.select(*key).collect())
    for parts in (1, 8, 64):
        b = entity_scan(p, "patient_id", ["hour", "event_id"], ["v"], parts=parts, with_count=True)
        assert _null_first(tuple(r) for r in b.select(*key).collect()) == want


def test_hot_entity_is_split_into_segments(spark):
    # one entity holds most rows, another is NULL; the hot one lies in many segments
    n = 5000
    rows = [(1, h, h, float(h % 17) if h % 5 else None) for h in range(n)] + \
           [(e, h, n + 30 * (e or 0) + h, float(h)) for h in range(20) for e in (0, 2, None)]
    df = spark.createDataFrame(rows, "e long, t int, tie long, v double")
    key = ["e", "t", *SCANNED]
    want = _null_first(tuple(r) for r in _plain(df, "e", ["t", "tie"], "v").select(*key).collect())
    placed = place(df, "e", ["t", "tie"], parts=40)
    sizes = [r["count"] for r in placed.groupBy(SEGMENT).count().collect()]
    assert len(sizes) > 30 and max(sizes) < n / 10
    for d in (placed, df):
        got = entity_scan(d, "e", ["t", "tie"], ["v"], with_count=True).select(*key).collect()
        assert _null_first(tuple(r) for r in got) == want


def test_only_entities_of_over_two_shares_are_cut(spark):
    even = spark.range(4000).selectExpr("id % 40 AS e", "id AS t", "double(id) AS v")
    assert [tuple(r) for r in place(even, "e", ["t"], parts=8).select(SEGMENT, CUT).distinct().collect()] == [(0, False)]
    tied = even.withColumn("t", F.lit(7)).withColumn("e", F.lit(1).cast("long"))  # all rows tie: no bound can cut them
    assert place(tied, "e", ["t"], parts=8).select(SEGMENT).distinct().count() == 1


def test_scan_of_an_empty_table_is_empty(spark):
    df = spark.createDataFrame([], "e long, t int, v double")
    assert entity_scan(df, "e", ["t"], ["v"]).count() == 0


def test_null_edges_fill(spark):
    # null head / middle / tail / whole column, one entity
    rows = [(1, 0, None, None), (1, 1, 2.0, None), (1, 2, None, None), (1, 3, 4.0, None), (1, 4, None, None)]
    df = spark.createDataFrame(rows, "patient_id long, hour int, hr double, temp double")
    spec = PanelSpec(tie=None)
    out = clean.locf_fill(df, spec, ["hr", "temp"], parts=3).orderBy("hour").collect()
    assert [r.hr for r in out] == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert all(r.temp is None for r in out)
    filled = clean.median_fill(clean.locf_fill(df, spec, ["hr", "temp"]), ["hr", "temp"])
    assert {r.temp for r in filled.collect()} == {0.0}


def test_clip_keeps_null_and_nan_normalised(spark):
    df = spark.createDataFrame([(None,), (150.0,), (float("nan"),), (50.0,)], "hr double")
    df = clean.downcast(df)
    out = [r.hr for r in clean.clip_outliers(df).collect()]
    assert out == [None, 100.0, None, 60.0]


def test_trend_closed_form_matches_polyfit(spark):
    vals = [3.0, 5.0, 4.0, 10.0, 7.5]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(vals)],
                               "patient_id long, hour int, event_id long, hr double")
    out = temporal.temporal_features(df, SPEC, measures=["hr"], parts=3).orderBy("hour").collect()
    for i, r in enumerate(out):
        if i == 0:
            assert r.hr_trend is None
        else:
            w = vals[max(0, i - 2): i + 1]
            assert abs(np.polyfit(range(len(w)), w, 1)[0] - r.hr_trend) < 1e-12


def test_ordinal_rank_matches_row_number(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"), "id")
    r = ordinal_rank(df, ["g"], ["v", "id"], out="r")
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    assert r.join(ref, ["g", "v", "id"]).filter("r != r2").count() == 0
    assert r.count() == 3000


def test_prefix_sums_match_window(spark):
    rng = np.random.default_rng(1)
    rows = [(m, float(p), int(rng.integers(0, 5))) for m in ("a", "b") for p in rng.random(400)]
    df = spark.createDataFrame(rows, "model string, p double, c long").dropDuplicates(["model", "p"])
    got = prefix_sums(df, ["model"], "p", ["c"], descending=True, nbuckets=7)
    w = Window.partitionBy("model").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("c").over(w))
    assert got.join(ref, ["model", "p"]).filter("c_cum != ref").count() == 0


def test_distributed_quantiles_equal_builtin(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g in range(3) for x in rng.normal(size=301)] + [(1, 0.25)] * 400 + [(3, 7.0), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    a = quantiles_by(df, ["g"], "v", [0.25, 0.5, 0.9], nparts=13).orderBy("g").collect()
    assert [r.g for r in a] == [0, 1, 2, 3]  # a group without values has no row
    for r in a:
        xs = np.array([v for g, v in rows if g == r.g and v is not None])
        for i, q in enumerate([0.25, 0.5, 0.9]):
            assert abs(r[f"q{i}"] - np.quantile(xs, q)) < 1e-12
