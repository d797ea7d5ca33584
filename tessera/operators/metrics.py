"""Exact evaluation metrics on a long prediction table.

Input: one row per (model, scored row) with the label ``y`` (0/1) and the
probability ``p``. Curve metrics first collapse rows to one per distinct
(model, p) with positive/negative counts - partial aggregation, so a score
shared by a third of all rows is just one row - and then take running sums
with ``prefix_sums`` (quantile buckets, no one-task window). Threshold tables
compute every threshold's counts as conditional sums in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..session import ensure_checkpoint_dir
from .ordering import join_small, prefix_sums, unpivot


def predictions_long(wide: DataFrame, pred_cols: list, row_id: str = "row_id", label: str = "y",
                     ensemble: str | None = "ensemble", names: list | None = None,
                     extra_keys: list | None = None) -> DataFrame:
    """Wide predictions -> long (row_id, y, model, p); with ``ensemble`` the
    row mean of the base predictions is added as one more model (H11).
    Invalid predictions become 0.5 (B10)."""
    names = names or pred_cols
    cols = {n: X.invalid_to(c) for n, c in zip(names, pred_cols)}
    if ensemble:
        cols[ensemble] = X.row_mean([X.invalid_to(c) for c in pred_cols])
    keys = [row_id] + list(extra_keys or [])
    w = wide.select(*keys, F.col(label).cast("int").alias("y"), *[v.alias(k) for k, v in cols.items()])
    return unpivot(w, [*keys, "y"], list(cols), "model", "p")


def score_counts(long: DataFrame, groups=("model",)) -> DataFrame:
    """One row per distinct (group, p): pos and neg counts."""
    return long.groupBy(*groups, "p").agg(F.sum("y").cast("long").alias("pos"),
                                        (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))


def _cumulative(counts: DataFrame, groups=("model",)) -> DataFrame:
    """Of ``score_counts``: tp/fp = positives/negatives scored >= p."""
    cum = prefix_sums(counts, list(groups), "p", ["pos", "neg"], descending=True)
    return cum.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp"})


def auc_table(long: DataFrame, groups=("model",)) -> DataFrame:
    """H1 + H2 per model (or any groups, e.g. model and fold for E6): AUROC
    with ties counted half (Mann-Whitney), and average precision in step
    form sum(delta recall * precision)."""
    c = _cumulative(score_counts(long, groups), groups)
    g = c.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("__u"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("__ap"))
    return g.select(*groups,
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("__u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
                    F.when(F.col("n_pos") > 0, F.col("__ap") / F.col("n_pos")).alias("auprc"))


def confusion(long: DataFrame, thresholds: list, groups=("model",)) -> DataFrame:
    """H3: TP/TN/FP/FN per group and threshold (predicted positive when
    p >= t). One aggregation pass: class totals once, and two conditional
    counts per threshold (few aggregation buffers, so whole-stage codegen
    stays on); FN and TN follow from the totals. Partial aggregation runs
    before the shuffle, then one row per (group, threshold) is unpivoted."""
    y1 = F.col("y") == 1
    aggs = [F.count_if(y1).alias("__P"), F.count_if(~y1).alias("__N")]
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= X.dlit(t)
        aggs += [F.count_if(hit & y1).alias(f"tp{i}"), F.count_if(hit & ~y1).alias(f"fp{i}")]
    wide = long.groupBy(*groups).agg(*aggs)
    parts = ", ".join(f"CAST({float(t)!r} AS DOUBLE), tp{i}, fp{i}" for i, t in enumerate(thresholds))
    lg = wide.selectExpr(*groups, "__P", "__N", f"stack({len(thresholds)}, {parts}) AS (t, tp, fp)")
    return lg.select(*groups, "t", F.col("tp").cast("long").alias("tp"),
                     (F.col("__N") - F.col("fp")).cast("long").alias("tn"),
                     F.col("fp").cast("long").alias("fp"),
                     (F.col("__P") - F.col("tp")).cast("long").alias("fn"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rates(conf: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision, F1, accuracy from confusion
    counts; 0 when undefined (zero_division = 0)."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    return conf.select(
        "*",
        rec.alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
        prec.alias("precision"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"))


def sens_spec(long: DataFrame, thresholds=None) -> DataFrame:
    """H4: sensitivity and specificity at 0.1, 0.2, 0.3, 0.5."""
    r = rates(confusion(long, thresholds or C.EVAL_THRESHOLDS))
    return r.select("model", F.col("t").alias("threshold"), "sensitivity", "specificity")


def threshold_comparison(long: DataFrame, thresholds=None, pivot: bool = False) -> DataFrame:
    """H5: precision, recall, F1, accuracy per model x threshold
    (0.3/0.5/0.7), long (model, threshold, metric, score) or pivoted to
    (model, metric, one column per threshold)."""
    ths = thresholds or C.COMPARE_THRESHOLDS
    r = rates(confusion(long, ths))
    lg = r.selectExpr("model", "t AS threshold",
                      "stack(4, 'Precision', precision, 'Recall', sensitivity, "
                      "'F1-Score', f1, 'Accuracy', accuracy) AS (metric, score)")
    if not pivot:
        return lg
    return lg.groupBy("model", "metric").pivot("threshold", [float(t) for t in ths]).agg(F.first("score"))


def threshold_sweep(long: DataFrame, percents=None) -> DataFrame:
    """H6: sensitivity, specificity, precision and F1 at 0.10 .. 0.90."""
    ths = [p / 100.0 for p in (percents or C.SWEEP_PERCENTS)]
    r = rates(confusion(long, ths))
    return r.select("model", F.col("t").alias("threshold"), "sensitivity", "specificity", "precision", "f1")


def _stored_counts(long: DataFrame) -> DataFrame:
    """``score_counts``, written once: the bucket bounds, the running sums and the totals read it."""
    ensure_checkpoint_dir(long.sparkSession)
    return score_counts(long).checkpoint()


def roc_curve(long: DataFrame) -> DataFrame:
    """H7: (fpr, tpr) at every distinct threshold per model, plus the origin
    (threshold NULL). All thresholds are kept."""
    counts = _stored_counts(long)
    tot = counts.groupBy("model").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pts = join_small(_cumulative(counts).alias("c"), tot, "model").select(
        "model", F.col("c.p").alias("threshold"),
        _ratio(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"))
    origin = tot.select("model", F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_curve(long: DataFrame) -> DataFrame:
    """H8: (precision, recall) at every distinct threshold per model plus
    the final (precision 1, recall 0) point (threshold NULL)."""
    counts = _stored_counts(long)
    tot = counts.groupBy("model").agg(F.sum("pos").alias("n_pos"))
    pts = join_small(_cumulative(counts).alias("c"), tot, "model").select(
        "model", F.col("c.p").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("recall"))
    end = tot.select("model", F.lit(None).cast("double").alias("threshold"),
                     F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def brier(long: DataFrame) -> DataFrame:
    """H9: mean squared difference of p and y per model."""
    d = F.col("p") - F.col("y")
    return long.groupBy("model").agg(F.avg(d * d).alias("brier"))


def calibration_bins(n_bins: int = 10) -> list:
    """Inner edges of ``n_bins`` uniform bins on [0, 1], computed as i*step
    (numpy ``linspace``'s doubles)."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def calibration(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Uniform bins, right-closed: bin = number of inner edges below p;
    empty bins are absent. Mean p, fraction positive and count per bin."""
    b = sum(((F.col("p") > X.dlit(e)).cast("int") for e in calibration_bins(n_bins)), F.lit(0))
    return (long.withColumn("bin", b)
            .groupBy("model", "bin").agg(F.avg("p").alias("mean_predicted"),
                                         F.avg(F.col("y").cast("double")).alias("fraction_positive"),
                                         F.count(F.lit(1)).alias("count")))


def evaluate(long: DataFrame, thresholds=None) -> DataFrame:
    """H12 / ``evaluate``: one (model, metric, value) table with AUROC,
    AUPRC and sensitivity/specificity at each threshold."""
    a = auc_table(long).selectExpr("model", "stack(2, 'AUROC', auroc, 'AUPRC', auprc) AS (metric, value)")
    ss = sens_spec(long, thresholds).select(
        "model", F.format_string("%s", F.col("threshold")).alias("t"), "sensitivity", "specificity")
    ss = ss.selectExpr("model", "stack(2, concat('Sens_@', t), sensitivity, concat('Spec_@', t), specificity) "
                                "AS (metric, value)")
    return a.unionByName(ss)
