"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (through the fixture views, which only
reshape them) and runs the library's operators over all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import PREDICTION_LOG_CAP, PanelSpec
from pyspark.sql import Window

from ..functions import exprs as X
from ..operators import clean, meta, metrics, monitor, quality, reports, scoring, splits, temporal, windows
from ..operators.panel_model import PanelPreprocessor, PanelPreprocessorModel
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..streaming import monitor_stream

PANEL = PanelSpec()  # patient_id / hour / event_id / label


def q_panel_clip(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.panel(spark, sf)
    return clean.clip_outliers(p).select("patient_id", "hour", "event_id", "hr", "temp", "resp", "wbc", "lactate")


def q_deterioration_score(spark: SparkSession, sf: str) -> DataFrame:
    return clean.deterioration_score(fx.panel(spark, sf)).select("patient_id", "hour", "vital_deterioration_score")


def q_locf_fill(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.panel(spark, sf)
    return clean.locf_fill(p, PANEL).select("patient_id", "hour", "event_id", "label",
                                            "hr", "temp", "resp", "wbc", "lactate")


def q_load_imputation(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.panel(spark, sf)
    return clean.load_imputation(p, PANEL).select("patient_id", "hour", "event_id", "label",
                                                  "hr", "temp", "resp", "wbc", "lactate")


def q_temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.temporal_features(fx.panel(spark, sf), PANEL)


def q_temporal_features_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """Same result from 64 range partitions instead of the session's number."""
    return temporal.temporal_features(fx.panel(spark, sf), PANEL, parts=64)


def q_temporal_features_hot(spark: SparkSession, sf: str) -> DataFrame:
    """D2-D6 where one patient holds two thirds of the rows."""
    return temporal.temporal_features(fx.panel_hot(spark, sf), PANEL)


def q_load_imputation_hot(spark: SparkSession, sf: str) -> DataFrame:
    """C1-C4 where one patient holds two thirds of the rows, the others lack a
    measure (global median) and one measure has no value (0)."""
    return clean.load_imputation(fx.panel_hot(spark, sf), PANEL).select(
        "patient_id", "hour", "event_id", "label", "hr", "temp", "resp", "wbc", "lactate")


def q_advanced_imputation_hot(spark: SparkSession, sf: str) -> DataFrame:
    """C5-C8 on a panel that was not imputed before: one patient holds two
    thirds of the rows, the others lack a lab, one lab has no value."""
    scored = clean.deterioration_score(fx.panel_hot(spark, sf))
    return clean.advanced_imputation(temporal.temporal_features(clean.clip_outliers(scored), PANEL, score=False), PANEL)


def q_last_window(spark: SparkSession, sf: str) -> DataFrame:
    """D7 + D8 on histories of 1..9 rows: last 6 rows, zero rows in front."""
    p = fx.panel_short(spark, sf)
    ms = ["hr", "temp", "resp", "wbc", "lactate"]
    return windows.pad_front(windows.last_rows(p, PANEL), PANEL, ms)


def q_last_label(spark: SparkSession, sf: str) -> DataFrame:
    return windows.last_label(fx.panel(spark, sf), PANEL)


def _prepared(spark, sf):
    return windows.prepare_windows(fx.panel(spark, sf), PANEL)


def q_prepare_windows(spark: SparkSession, sf: str) -> DataFrame:
    """D14 end to end: one scaled 6-step window per patient, long form."""
    long, _labels, _stats, flist = _prepared(spark, sf)
    return long.select("patient_id", "step", "is_pad", *[F.round(c, 6).alias(c) for c in flist])


def q_robust_scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    _long, _labels, stats, _ = _prepared(spark, sf)
    return stats.select("feature", F.round("center", 9).alias("center"), F.round("scale", 9).alias("scale"))


def q_window_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """D10 + D11: windows collected to arrays, flattened time-major, one row
    per (patient, position)."""
    long, _labels, _stats, flist = _prepared(spark, sf)
    arr = windows.flatten_window(windows.window_arrays(long, PANEL, flist))
    return arr.select("patient_id", F.posexplode("flat").alias("pos", "value")).select(
        "patient_id", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


def q_fitted_panel(spark: SparkSession, sf: str) -> DataFrame:
    """A8 + B6 + D13: the panel transformer fitted on the training patients, saved,
    loaded, and applied to the test patients, whose panel lacks one measure."""
    p = fx.panel_short(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/panel-model-{uuid.uuid4().hex}"
    PanelPreprocessor(PANEL, output="long").fit(splits.take_split(p, "patient_id", "train")).write().save(path)
    out = PanelPreprocessorModel.load(path).transform(splits.take_split(p, "patient_id", "test").drop("wbc"))
    return out.withColumns({c: F.round(c, 9) for c in out.columns[3:]})


# ------------------------------------------------------------ meta (G)

MODELS = fx.MODEL_COLS
ROUNDED_META = (["ensemble_mean", "ensemble_std", "ensemble_range", "ensemble_median",
                 "high_confidence", "low_confidence", "disagreement"])


def _r6(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _meta(spark, sf):
    return meta.meta_features(fx.preds(spark, sf), MODELS)


def q_meta_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 51-column meta dataset over the six base predictions."""
    # row-wise values are computed in the same order in both engines, so
    # they are compared unrounded
    return _meta(spark, sf)


def q_target_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return meta.target_distribution(fx.preds(spark, sf)).withColumn("class_ratio", F.round("class_ratio", 6))


def q_meta_target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    m = _meta(spark, sf)
    c = meta.target_correlations(m, meta.meta_column_names(MODELS)).select(
        "feature", F.round("corr", 6).alias("corr"))
    w = Window.orderBy(F.abs(F.col("corr")).desc_nulls_last(), F.col("feature"))
    return c.withColumn("rank", F.row_number().over(w))


def q_meta_describe(spark: SparkSession, sf: str) -> DataFrame:
    d = meta.describe(_meta(spark, sf), meta.meta_column_names(MODELS))
    return d


def q_meta_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    mi = meta.mutual_information(_meta(spark, sf), meta.meta_column_names(MODELS))
    return _r6(mi, ["mi"])


def q_scoring_meta_features(spark: SparkSession, sf: str) -> DataFrame:
    return meta.scoring_meta_features(fx.preds(spark, sf), MODELS, ["row_id"])


# --------------------------------------------------------- metrics (H)

def _plong(spark, sf):
    return metrics.predictions_long(fx.preds(spark, sf), MODELS)


def q_model_auc(spark: SparkSession, sf: str) -> DataFrame:
    """H1 + H2 (+ H11: the mean ensemble as a seventh model)."""
    return _r6(metrics.auc_table(_plong(spark, sf)), ["auroc", "auprc"])


def q_sens_spec(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.sens_spec(_plong(spark, sf)), ["sensitivity", "specificity"])


def q_threshold_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.threshold_comparison(_plong(spark, sf)), ["score"])


def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.threshold_sweep(_plong(spark, sf)), ["sensitivity", "specificity", "precision", "f1"])


def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.roc_curve(_plong(spark, sf)), ["fpr", "tpr"])


def q_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.pr_curve(_plong(spark, sf)), ["precision", "recall"])


def q_brier_score(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.brier(_plong(spark, sf)), ["brier"])


def q_calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.calibration(_plong(spark, sf)), ["mean_predicted", "fraction_positive"])


def q_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(metrics.evaluate(_plong(spark, sf)), ["value"])


# --------------------------------------------------------- reports (I)

def _hist(df: DataFrame) -> DataFrame:
    return df.withColumn("series_mean", F.round("series_mean", 6))


def _ens(spark, sf):
    """The mean ensemble's (row_id, y, p)."""
    return _plong(spark, sf).filter(F.col("model") == "ensemble").select("row_id", "y", "p")


def _wide(spark, sf):
    pr = fx.preds(spark, sf)
    return pr.withColumn("ensemble", X.row_mean(MODELS))


def q_prediction_histograms(spark, sf):
    """30-bin density histogram of each model's probabilities."""
    return _hist(reports.prediction_histograms(_plong(spark, sf), 30))


def q_probability_histograms_20(spark, sf):
    """20-bin version used next to the calibration table."""
    return _hist(reports.prediction_histograms(_plong(spark, sf), 20))


def q_disagreement_histogram(spark, sf):
    return _hist(reports.disagreement_histogram(_meta(spark, sf)))


def q_confidence_histogram(spark, sf):
    return _hist(reports.confidence_histogram(_meta(spark, sf)))


def q_ensemble_stat_correlation(spark, sf):
    return _r6(reports.ensemble_stat_correlation(_meta(spark, sf)), ["abs_corr"])


def q_error_box_stats(spark, sf):
    return reports.error_box_stats(_ens(spark, sf))


def q_outcome_shares(spark, sf):
    return reports.outcome_shares(_ens(spark, sf))


def q_error_agreement(spark, sf):
    return reports.error_agreement(_wide(spark, sf), "ensemble", MODELS)


def q_error_histogram_by_class(spark, sf):
    return _hist(reports.error_histogram_by_class(_ens(spark, sf)))


def q_error_projection(spark, sf):
    return reports.with_error(_ens(spark, sf))


def q_high_error_histogram(spark, sf):
    return _hist(reports.high_error_histogram(_ens(spark, sf)))


def q_model_band_table(spark, sf):
    return reports.model_band_table(_plong(spark, sf))


def q_confidence_by_class(spark, sf):
    return _hist(reports.confidence_by_class(_plong(spark, sf)))


def q_row_uncertainty(spark, sf):
    return reports.row_uncertainty(fx.preds(spark, sf), MODELS)


def q_uncertainty_histograms(spark, sf):
    return _hist(reports.uncertainty_histograms(reports.row_uncertainty(fx.preds(spark, sf), MODELS)))


def q_high_uncertainty_cases(spark, sf):
    return reports.high_uncertainty_cases(reports.row_uncertainty(fx.preds(spark, sf), MODELS))


def q_decision_bins(spark, sf):
    return reports.decision_bins(_plong(spark, sf))


def q_measure_correlation(spark, sf):
    """I20 on the forward/backward-filled panel (the raw panel has one
    measure per row, so no pair would be complete)."""
    filled = clean.locf_fill(fx.panel(spark, sf), PANEL)
    return _r6(reports.correlation_pairs(filled, ["hr", "temp", "resp", "wbc", "lactate"]), ["r"])


def q_meta_correlation_matrix(spark, sf):
    return _r6(reports.correlation_matrix(_meta(spark, sf), meta.meta_column_names(MODELS)), ["r"])


def q_ensemble_std_histogram(spark, sf):
    return _hist(reports.histogram(_meta(spark, sf), "ensemble_std", [], 50))


def q_top_contributions(spark, sf):
    """Top 15 meta-feature values by magnitude per row, with running
    totals (waterfall)."""
    m = _meta(spark, sf)
    names = meta.meta_column_names(MODELS)
    lg = reports.row_top(m, "row_id", names, "feature", "value", 15)
    return reports.top_contributions(lg, "row_id", "feature", "value", 15)


# ---------------------------------------------------------- quality (J)

def q_null_profile(spark, sf):
    return _r6(quality.null_percent(fx.panel(spark, sf)), ["null_percent"])


def q_panel_profile(spark, sf):
    return _r6(quality.profile(fx.panel(spark, sf), PANEL), ["null_pct_mean", "null_pct_min", "null_pct_max"])


def q_label_distribution(spark, sf):
    return quality.label_distribution(fx.panel(spark, sf), "label")


def q_class_imbalance(spark, sf):
    return _r6(quality.class_imbalance(fx.panel(spark, sf), "label"), ["imbalance_ratio"])


def _request_windows(spark, sf):
    """Score requests: each patient's last 6 filled rows (zero-padded) as a
    6 x 5 array, from the short-history panel."""
    ms = ["hr", "temp", "resp", "wbc", "lactate"]
    filled = clean.locf_fill(fx.panel_short(spark, sf), PANEL)
    long = windows.pad_front(windows.last_rows(filled, PANEL), PANEL, ms)
    return windows.window_arrays(long, PANEL, ms, out="features")


def q_input_checks(spark, sf):
    """Shape, NaN/inf and value-range checks per request."""
    return quality.input_checks(_request_windows(spark, sf), "features", steps=6).drop("features")


def q_request_checks(spark, sf):
    """J7 + J8 on requests of which some are ragged, too short, NaN, infinite
    or incomplete."""
    c = quality.input_checks(fx.requests(spark, sf), "features", steps=6, width=10)
    return c.select("request_id", "n_steps", "n_features", "shape_ok", "has_null", "has_nan", "has_inf", "is_valid")


def q_validation_report(spark, sf):
    """All panel checks as one findings table."""
    return quality.validation_report(fx.panel(spark, sf), PANEL)


# ---------------------------------------------------------- scoring (K)

def q_risk_levels(spark, sf):
    """B8 on the ensemble probability."""
    e = _ens(spark, sf)
    return clean.risk_levels(e, "p").select("row_id", "p", "risk_level")


def q_score_summary(spark, sf):
    """K1-K3: probability, risk, confidence and the explanation's numbers
    (the struct and map are flattened for comparison)."""
    w = _wide(spark, sf)
    s = scoring.score_summary(w, MODELS, "ensemble", ["row_id"])
    return s.select("row_id", "probability", "risk_level", "confidence",
                    F.col("explanation.ensemble_mean").alias("ensemble_mean"),
                    F.col("explanation.prediction_std").alias("prediction_std"),
                    F.col("explanation.model_count").alias("model_count"),
                    F.col("explanation.base_predictions")["model_0"].alias("model_0"))


def q_explain_contributions(spark, sf):
    return scoring.contributions(fx.preds(spark, sf), MODELS, ["row_id"])


def q_explain_summary(spark, sf):
    return scoring.explain_summary(fx.preds(spark, sf), MODELS, ["row_id"])


def _flat_rows(spark, sf):
    """Batch-scoring input: one flat row of numbers per patient (its filled
    measures hour by hour, 5 to 45 values)."""
    ms = ["hr", "temp", "resp", "wbc", "lactate"]
    filled = clean.locf_fill(fx.panel_short(spark, sf), PANEL)
    g = filled.groupBy("patient_id").agg(
        F.array_sort(F.collect_list(F.struct("hour", F.array(*ms).alias("v")))).alias("__r"))
    return g.select("patient_id", F.flatten(F.transform("__r", lambda x: x["v"])).alias("values"))


def q_batch_windows(spark, sf):
    """K4: flat rows reshaped to 6 x ceil(n/6) windows with zero padding."""
    r = scoring.reshape_flat(_flat_rows(spark, sf), "values")
    st = r.select("patient_id", F.posexplode("window").alias("step", "row"))
    return st.select("patient_id", F.col("step").cast("int").alias("step"),
                     F.posexplode("row").alias("j", "value")).select(
        "patient_id", "step", F.col("j").cast("int").alias("j"), "value")


def q_batch_results(spark, sf):
    """K5 + K6: scored rows with index, default patient id and risk; rows
    whose base predictions are invalid are routed apart."""
    w = _wide(spark, sf).withColumn("__ok", F.lit(True))
    for m in MODELS:
        w = w.withColumn("__ok", F.col("__ok") & F.col(m).isNotNull() & (F.col(m) >= 0) & (F.col(m) <= 1))
    good, _bad, _tot, _first = scoring.route_errors(w, "__ok", "row_id")
    return scoring.batch_rows(good, "row_id", None, "ensemble")


def q_batch_errors(spark, sf):
    """K6 on predictions of which some are missing, NaN or above 1: every row
    under good or bad, the first 10 bad ones and the totals."""
    d = fx.preds_dirty(spark, sf)
    ok = F.lit(True)
    for m in MODELS:
        ok = ok & F.col(m).isNotNull() & ~F.isnan(m) & (F.col(m) >= 0) & (F.col(m) <= 1)
    good, bad, totals, first = scoring.route_errors(d.withColumn("ok", ok), "ok", "row_id")
    parts = [df.select(F.lit(part).alias("part"), "row_id", F.lit(None).cast("long").alias("total"))
             for part, df in (("good", good), ("bad", bad), ("first", first))]
    sums = totals.unpivot([], ["total_processed", "total_errors"], "part", "total")
    parts.append(sums.select("part", F.lit(None).cast("long").alias("row_id"), "total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -------------------------------------------------------- monitoring (L)

def q_performance_summary(spark, sf):
    """L1 + L2 for the 7 days up to the log's last entry."""
    log = fx.predlog(spark, sf)
    s = monitor.performance_summary(log, monitor.latest_time(log), 7)
    return _r6(s, ["prediction_mean", "prediction_std", "confidence_mean", "confidence_std",
                   "mean_processing_time_ms"])


def q_recent_log(spark, sf):
    """L3: the retained (most recent 10,000) log entries."""
    return monitor.recent_entries(fx.predlog(spark, sf), PREDICTION_LOG_CAP)


def q_recent_log_short(spark, sf):
    """L3 with a cap that is shorter than the log: the 250 most recent entries."""
    return monitor.recent_entries(fx.predlog(spark, sf), 250)


def q_monitor_windows(spark, sf):
    """L5 batch twin: the summary per 7-day window sliding by a day."""
    return _r6(monitor.window_summary(fx.predlog(spark, sf)),
               ["prediction_mean", "prediction_std", "confidence_mean"])


# ------------------------------------------------------------ splits (E)

def q_group_kfold(spark, sf):
    p = fx.panel(spark, sf).select("patient_id", "hour")
    return splits.group_folds(p, "patient_id", 5, method="rank")


def q_stratified_kfold(spark, sf):
    return splits.stratified_folds(fx.preds(spark, sf).select("row_id", "y"), "y", "row_id", 5)


def q_holdout_split(spark, sf):
    """E1 + E2: whole patients to train/test by a seeded hash."""
    return splits.holdout_split(fx.panel(spark, sf).select("patient_id", "hour"), "patient_id")


def _fold_long(spark, sf):
    f = splits.stratified_folds(fx.preds(spark, sf), "y", "row_id", 5)
    return metrics.predictions_long(f.withColumnRenamed("fold", "fold_id"), MODELS, extra_keys=["fold_id"])


def q_fold_auc(spark, sf):
    """AUROC/AUPRC per model and stratified fold."""
    return _r6(metrics.auc_table(_fold_long(spark, sf), ("model", "fold_id")), ["auroc", "auprc"])


def q_cv_summary(spark, sf):
    """Mean and population std of the fold AUROCs per model."""
    a = metrics.auc_table(_fold_long(spark, sf), ("model", "fold_id"))
    return _r6(splits.cv_summary(a), ["cv_auc", "cv_std"])


# ----------------------------------------------------------- learners (F)

def _embedded(spark, sf):
    """embeddings -> (row_id, features vector, label 0/1)."""
    from pyspark.ml.functions import array_to_vector
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
                    (F.col("label") != 0).cast("double").alias("label"))


def q_scoring_ranks(spark, sf):
    """Share of training scores (even rows) below each score of the other rows, six models."""
    long = fx.preds(spark, sf).unpivot(["row_id"], [f"m{i}" for i in range(6)], "model", "p")
    scores = long.where("row_id % 2 = 1")
    shares = meta.training_shares(meta.score_counts(long.where("row_id % 2 = 0")), scores)
    return scores.join(shares, ["model", "p"]).select("row_id", "model", "share")


def q_class_weights(spark, sf):
    """F8: balanced class weights n / (2 n_class) per row."""
    from ..operators import learners
    w = learners.class_weights(_embedded(spark, sf), "label")
    return w.select("row_id", F.col("label").cast("int").alias("label"), F.round("weight", 9).alias("weight"))


def _whole_learners(n_features):
    """The learners whose fits at the reference's full settings end in seconds: forest, logistic regression, neural model."""
    from ..operators import learners
    return {k: v for k, v in learners.base_learners(n_features).items() if k in ("RandomForest", "LogisticRegression", "CNN_Medical")}


def q_oof_predictions(spark, sf):
    """E5 + F4-F6: out-of-fold probabilities of the forest (300 trees), the logistic regression and the
    neural model at full settings over 3 stratified folds (rows-only)."""
    from ..operators import learners
    d = splits.stratified_folds(_embedded(spark, sf), "label", "row_id", 3)
    return learners.out_of_fold(d, _whole_learners(64), "row_id", "fold", 3, parallel=3)


def q_oof_coverage(spark, sf):
    """E5: what must hold of the out-of-fold predictions: each row once per
    model, in its fold, with its label and a probability."""
    return q_oof_predictions(spark, sf).groupBy("row_id", "model").agg(
        F.count(F.lit(1)).alias("n"), F.max("fold").alias("fold"), F.max("label").alias("label"),
        F.bool_and((F.col("p") >= 0) & (F.col("p") <= 1)).alias("is_probability"))


def q_importance_checks(spark, sf):
    """what must hold of the whole forest's importances: one per
    feature, none negative, together 1."""
    from ..operators import learners
    m = _whole_learners(64)["RandomForest"].fit(learners.class_weights(learners.fit_rows(_embedded(spark, sf)), "label"))
    return learners.feature_importances(m).agg(
        F.countDistinct("feature").alias("n_features"), (F.min("importance") >= 0).alias("none_negative"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"))


def q_top_importances(spark, sf):
    """F10 + I23: top-20 feature importances of the forest at full settings."""
    from ..operators import learners
    d = learners.class_weights(learners.fit_rows(_embedded(spark, sf)), "label")
    m = _whole_learners(64)["RandomForest"].fit(d)
    return reports.top_importances(learners.feature_importances(m), 20)


def q_mutual_information_knn(spark, sf):
    """Neighbour estimate (k = 3) of each base prediction's mutual information with the label."""
    return meta.mutual_information_knn(fx.preds(spark, sf), MODELS).select("feature", F.round("mi", 9).alias("mi"))


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_batch_csv(spark, sf):
    """A2: the log as a CSV batch, every eleventh confidence no number: rows that do not parse are routed, not lost."""
    from ..sources import io
    log, path = fx.predlog(spark, sf), _folder(spark, "batch-csv")
    log.select("id", "prediction", F.when(F.col("id") % 11 == 0, F.lit("n/a")).otherwise(F.col("confidence").cast("string")).alias("confidence")) \
        .write.option("header", True).csv(path)
    schema = StructType().add("id", "long").add("prediction", "double").add("confidence", "double")
    rows = io.read_batch_csv(spark, path, schema)
    return rows.select("id", "prediction", "confidence", F.col("_corrupt_record").isNotNull().alias("failed"))


def q_meta_dataset_csv(spark, sf):
    """A1 + A5 + B1 + B2: the meta dataset written as CSV with an exported row number, read back with its schema."""
    from ..sources import io
    path = _folder(spark, "meta-csv")
    io.write_meta_dataset(fx.preds_dirty(spark, sf).select(F.col("row_id").alias("_c0"), "row_id", F.col("y").alias("label"), *MODELS), path, "csv")
    schema = StructType().add("_c0", "long").add("row_id", "long").add("label", "integer")
    for m in MODELS:
        schema.add(m, "double")
    return io.read_panel_csv(spark, path, schema)


def q_base_prediction_sink(spark, sf):
    """A4 + A6: predictions stored by model and read back with the metadata beside them."""
    from ..sources import io
    wide, path, about = fx.preds(spark, sf), _folder(spark, "base"), _folder(spark, "about")
    io.write_base_predictions(metrics.predictions_long(wide, MODELS, ensemble=None), path)
    io.write_metadata(spark, ["ensemble_mean"], MODELS, meta.target_distribution(wide), about)
    m = io.read_metadata(spark, about).first()
    stored = spark.read.parquet(path).where(F.col("saved_at").isNotNull())
    return stored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("sum_p")).select(
        "model", "n", "sum_p", F.lit(m["positive_class"]).alias("positive_class"), F.lit(m["negative_class"]).alias("negative_class"),
        F.lit(len(m["base_models"])).alias("n_models"))


def q_split_gains(spark, sf):
    """F1 + F3: histograms of gradients and curvatures over the base predictions' tenths, at the share of positive
    rows: the gain of every cut of the root, and of the two nodes that its best cut makes."""
    from ..operators import leafwise
    tenths = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    d = fx.preds(spark, sf).select(leafwise.binned(F.array(*MODELS), [tenths] * len(MODELS)).alias("bins"), "y")
    share = d.agg(F.avg("y")).first()[0] or 0.0
    d = d.select("bins", (F.lit(share) - F.col("y")).alias("g"), F.lit(share * (1 - share)).alias("h"))
    terms = dict(alpha=0.1, lam=2.0, min_rows=20, min_weight=1e-3)
    gains = leafwise.split_gains(leafwise.histograms(d.withColumn("node", F.lit(0))), **terms)
    best = leafwise.best_splits(gains).first()
    if best is not None:
        side = F.when(F.get("bins", F.lit(best.feature)) <= best.bin, 1).otherwise(2)
        gains = gains.unionByName(leafwise.split_gains(leafwise.histograms(d.withColumn("node", side)), **terms))
    return gains.select("node", "feature", F.col("bin").cast("int").alias("bin"), "nl", "n", F.round("gain", 6).alias("gain"))


def q_sketch_quantiles(spark, sf):
    """C3 + D12 + J4: sketches stored per day of ``events`` and merged without rereading it: does the exact rank
    of each approximate quantile lie within 1 % of it, the distinct count within 6 %?"""
    from ..operators import sketches
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    ev = fx.table(spark, sf, "events").select("value", F.col("event_id").cast("double").alias("event_id"), F.to_date("ts").alias("day"))
    names = ["value", "event_id"]
    sketches.part_sketches(ev, "day", names).write.parquet(path)
    merged = sketches.merged(spark.read.parquet(path)).checkpoint()
    asked = sketches.sketch_quantiles(merged, [0.05, 0.25, 0.5, 0.75, 0.95]).select("feature", "prob", "value").collect()  # ten rows
    ranks = [F.avg((F.col(r.feature) <= F.lit(r.value)).cast("double")).alias(f"r{i}") for i, r in enumerate(asked)]
    below = [F.avg((F.col(r.feature) < F.lit(r.value)).cast("double")).alias(f"b{i}") for i, r in enumerate(asked)]
    exact = ev.agg(*ranks, *below, *[F.countDistinct(c).alias(c) for c in names])
    near = F.explode(F.array(*[F.struct(
        F.lit(r.feature).alias("feature"), F.lit(r.prob).alias("prob"),
        ((F.col(f"r{i}") >= r.prob - 0.01) & (F.col(f"b{i}") <= r.prob + 0.01)).alias("rank_ok"),
        F.col(r.feature).alias("exact")) for i, r in enumerate(asked)])).alias("x")
    return exact.select(near).select("x.*").join(sketches.sketch_distincts(merged), "feature").select(
        "feature", "prob", "n", "rank_ok", (F.abs(F.col("distinct") - F.col("exact")) <= 0.06 * F.col("exact")).alias("distinct_ok"))


def q_report_status(spark, sf):
    """The report tables of the predictions, each written by its own job beside one that fails: name, ok, rows."""
    from ..sources import io
    from . import pipeline
    long = metrics.predictions_long(fx.preds(spark, sf), MODELS)
    path = f"{ensure_checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    names = ["precision_comparison", "brier", "model_bands", "threshold_sweep", "auc"]
    tables = {k: v for k, v in pipeline.comprehensive_report(long).items() if k in names}
    tables["broken"] = lambda: long.select(F.raise_error(F.lit("no such chart")).alias("x"))
    status = io.write_status(spark, io.write_reports_apart(tables, path), path)
    return status.select("name", "ok", "rows")


# ------------------------------------------------------------ streams (L)

def _arrivals(spark, name):
    """A new folder for a stream's files, and one for what is written from it."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def q_stream_ranks(spark, sf):
    """L4 + G15: the rows of ``scoring_ranks`` arrive as a stream of files; each is looked up in the
    stored sorted table and written by the idempotent sink."""
    src, out, ck = _arrivals(spark, "ranks")
    wide = fx.preds(spark, sf).select("row_id", *[F.col(m).alias(f"{m}_pred") for m in MODELS])
    wide.where("row_id % 2 = 1").repartition(3, "row_id").write.parquet(src)
    train = wide.where("row_id % 2 = 0").toDF("row_id", *MODELS).unpivot(["row_id"], MODELS, "model", "p")
    index = meta.rank_index(meta.score_counts(train), MODELS)
    index["table"] = index["table"].checkpoint()
    ranked = lambda d: meta.lookup_ranks(d, index, MODELS).select("row_id", *[F.col(f"{m}_rank").alias(m) for m in MODELS])
    stream = spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).parquet(src)
    monitor_stream.start_scoring(stream, ranked, out, ck).awaitTermination()
    done = monitor_stream.read_batches(spark, out, "row_id long, " + ", ".join(f"{m} double" for m in MODELS))
    return done.unpivot(["row_id"], MODELS, "model", "share")


def q_stream_closed_windows(spark, sf):
    """Nine tenths of the log arrive, then the rest, part of which is late: closed windows, each written once."""
    src, out, ck = _arrivals(spark, "windows")
    log = fx.predlog(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("id % 10 <> 0", "id % 10 = 0"):
        log.where(part).write.mode("append").parquet(src)
        summary = monitor_stream.summary_stream(spark.readStream.schema(log.schema).parquet(src))
        monitor_stream.start_closed_windows(summary, out, ck).awaitTermination()
    w = monitor_stream.read_batches(spark, out, monitor.window_summary(log).schema)
    w = w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    return _r6(w, ["prediction_mean", "prediction_std", "confidence_mean"])


def q_stream_recent_log(spark, sf):
    """L3 + A7: the log arrives in three batches; state keeps the newest 250 of every shard."""
    src, out, ck = _arrivals(spark, "log")
    log = fx.predlog(spark, sf)
    for k in range(3):
        log.where(F.pmod("id", F.lit(3)) == k).write.mode("append").parquet(src)
        entries = monitor_stream.running_log(spark.readStream.schema(log.schema).parquet(src), cap=250)
        monitor_stream.start_running_log(entries, out, ck).awaitTermination()
    return monitor_stream.read_running_log(spark, out, 250).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*log.columns)


def QUERIES() -> dict:
    return {
        "mutual_information_knn": q_mutual_information_knn,
        "sketch_quantiles": q_sketch_quantiles,
        "split_gains": q_split_gains,
        "batch_csv": q_batch_csv,
        "meta_dataset_csv": q_meta_dataset_csv,
        "base_prediction_sink": q_base_prediction_sink,
        "report_status": q_report_status,
        "stream_ranks": q_stream_ranks,
        "stream_closed_windows": q_stream_closed_windows,
        "stream_recent_log": q_stream_recent_log,
        "class_weights": q_class_weights,
        "scoring_ranks": q_scoring_ranks,
        "oof_predictions": q_oof_predictions,
        "oof_coverage": q_oof_coverage,
        "top_importances": q_top_importances,
        "importance_checks": q_importance_checks,
        "null_profile": q_null_profile,
        "panel_profile": q_panel_profile,
        "label_distribution": q_label_distribution,
        "class_imbalance": q_class_imbalance,
        "input_checks": q_input_checks,
        "validation_report": q_validation_report,
        "risk_levels": q_risk_levels,
        "score_summary": q_score_summary,
        "explain_contributions": q_explain_contributions,
        "explain_summary": q_explain_summary,
        "batch_windows": q_batch_windows,
        "batch_results": q_batch_results,
        "performance_summary": q_performance_summary,
        "recent_log": q_recent_log,
        "recent_log_short": q_recent_log_short,
        "batch_errors": q_batch_errors,
        "request_checks": q_request_checks,
        "monitor_windows": q_monitor_windows,
        "group_kfold": q_group_kfold,
        "stratified_kfold": q_stratified_kfold,
        "holdout_split": q_holdout_split,
        "fold_auc": q_fold_auc,
        "cv_summary": q_cv_summary,
        "prediction_histograms": q_prediction_histograms,
        "probability_histograms_20": q_probability_histograms_20,
        "disagreement_histogram": q_disagreement_histogram,
        "confidence_histogram": q_confidence_histogram,
        "ensemble_stat_correlation": q_ensemble_stat_correlation,
        "error_box_stats": q_error_box_stats,
        "outcome_shares": q_outcome_shares,
        "error_agreement": q_error_agreement,
        "error_histogram_by_class": q_error_histogram_by_class,
        "error_projection": q_error_projection,
        "high_error_histogram": q_high_error_histogram,
        "model_band_table": q_model_band_table,
        "confidence_by_class": q_confidence_by_class,
        "row_uncertainty": q_row_uncertainty,
        "uncertainty_histograms": q_uncertainty_histograms,
        "high_uncertainty_cases": q_high_uncertainty_cases,
        "decision_bins": q_decision_bins,
        "measure_correlation": q_measure_correlation,
        "meta_correlation_matrix": q_meta_correlation_matrix,
        "ensemble_std_histogram": q_ensemble_std_histogram,
        "top_contributions": q_top_contributions,
        "meta_features": q_meta_features,
        "target_distribution": q_target_distribution,
        "meta_target_correlation": q_meta_target_correlation,
        "meta_describe": q_meta_describe,
        "meta_mutual_information": q_meta_mutual_information,
        "scoring_meta_features": q_scoring_meta_features,
        "model_auc": q_model_auc,
        "sens_spec": q_sens_spec,
        "threshold_comparison": q_threshold_comparison,
        "threshold_sweep": q_threshold_sweep,
        "roc_curve": q_roc_curve,
        "pr_curve": q_pr_curve,
        "brier_score": q_brier_score,
        "calibration_curve": q_calibration_curve,
        "evaluate": q_evaluate,
        "last_window": q_last_window,
        "last_label": q_last_label,
        "prepare_windows": q_prepare_windows,
        "fitted_panel": q_fitted_panel,
        "robust_scaler_fit": q_robust_scaler_fit,
        "window_vectors": q_window_vectors,
        "panel_clip": q_panel_clip,
        "deterioration_score": q_deterioration_score,
        "locf_fill": q_locf_fill,
        "load_imputation": q_load_imputation,
        "temporal_features": q_temporal_features,
        "temporal_features_segmented": q_temporal_features_segmented,
        "temporal_features_hot": q_temporal_features_hot,
        "load_imputation_hot": q_load_imputation_hot,
        "advanced_imputation_hot": q_advanced_imputation_hot,
    }
