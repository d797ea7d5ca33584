"""The fitted panel transformer as a Spark ML stage.

``PanelPreprocessor.fit`` learns, on the training entities only, the median of
every measure, the feature list and the robust scaler's centers and scales;
``PanelPreprocessorModel.transform`` applies them to any panel without reading
a statistic from it: one placed copy, the ordered scans and a projection. Both
are ordinary pipeline stages: ``Pipeline([PanelPreprocessor(...), learner])``
goes from a raw panel to scores, and is saved and loaded as a whole.

A measure or feature that the panel to transform lacks is 0 before scaling
(B6), other columns of it are ignored. What is learned is one number or name
per feature, kept in the stage's parameters and hence in its metadata file.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import PanelSpec, present
from ..functions import exprs as X
from . import clean
from .scan import place
from .windows import (cut_windows, derived_features, flatten_window, last_label, panel_features, robust_scaler_fit,
                      to_vector, window_arrays, window_features)


class _PanelParams(Params):
    roles = Param(Params._dummy(), "roles", "column roles of the panel", TypeConverters.identity)
    window = Param(Params._dummy(), "window", "rows per entity", TypeConverters.toInt)
    featureMode = Param(Params._dummy(), "featureMode", "'all' or 'raw' features", TypeConverters.toString)
    imputeOnLoad = Param(Params._dummy(), "imputeOnLoad", "fill measures before features are derived", TypeConverters.toBoolean)
    scoreAfterClip = Param(Params._dummy(), "scoreAfterClip", "take the deterioration score of clipped values", TypeConverters.toBoolean)
    includePadding = Param(Params._dummy(), "includePadding", "fit the scaler on padding rows too", TypeConverters.toBoolean)
    output = Param(Params._dummy(), "output", "'vector': a row per entity; 'long': a row per entity and step", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the vector's column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(roles=_roles(PanelSpec()), window=C.TIME_WINDOW, featureMode="all", imputeOnLoad=True, scoreAfterClip=False,
                         includePadding=False, output="vector", outputCol="features")

    @property
    def spec(self) -> PanelSpec:
        r = dict(self.getOrDefault("roles"))
        return PanelSpec(**{**r, "vitals": tuple(r["vitals"]), "labs": tuple(r["labs"]), "exclude": frozenset(r["exclude"]),
                            "ranges": {k: tuple(v) for k, v in r["ranges"].items()}})


def _roles(spec: PanelSpec) -> dict:
    """A PanelSpec in values that a metadata file can hold."""
    d = asdict(spec)
    return {**d, "vitals": list(spec.vitals), "labs": list(spec.labs), "exclude": sorted(spec.exclude),
            "ranges": {k: list(v) for k, v in spec.ranges.items()}}


class PanelPreprocessor(Estimator, _PanelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, feature list and scaler from a panel of training entities."""

    def __init__(self, spec: PanelSpec | None = None, **params) -> None:
        super().__init__()
        self._set(**({"roles": _roles(spec)} if spec else {}), **params)

    def _fit(self, panel: DataFrame) -> PanelPreprocessorModel:
        spec = self.spec
        measures = present(panel.columns, spec.measures)
        base = place(panel, spec.entity, spec.order_cols())
        if self.getOrDefault("imputeOnLoad"):
            filled = clean.locf_fill(base, spec, measures).checkpoint()
            medians = clean.column_medians(filled, measures)
            base = clean.median_fill(filled, measures, medians=medians)
        else:
            vitals = present(measures, spec.vitals)
            medians = clean.column_medians(clean.locf_fill(clean.clip_outliers(base, spec.ranges), spec, vitals), measures)
        features = window_features(panel, spec, self.getOrDefault("featureMode"))
        rows = derived_features(base, spec, self.getOrDefault("scoreAfterClip"), medians)
        long = cut_windows(rows, spec, features, self.getOrDefault("window")).checkpoint()
        stats = {r["feature"]: r for r in robust_scaler_fit(long, features, self.getOrDefault("includePadding")).collect()}  # one row per feature
        model = PanelPreprocessorModel()
        model._set(medians=medians, features=features,
                   centers=[float(stats[f]["center"] or 0.0) for f in features], scales=[float(stats[f]["scale"] or 1.0) for f in features])
        return self._copyValues(model)


class PanelPreprocessorModel(Model, _PanelParams, DefaultParamsReadable, DefaultParamsWritable):
    """A panel as scaled windows, with learned medians, feature list and scaler."""

    medians = Param(Params._dummy(), "medians", "median or None by measure", TypeConverters.identity)
    features = Param(Params._dummy(), "features", "features in order", TypeConverters.toListString)
    centers = Param(Params._dummy(), "centers", "the scaler's center by feature", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "the scaler's scale by feature", TypeConverters.toListFloat)

    def long_windows(self, panel: DataFrame) -> DataFrame:
        """(entity, step, is_pad, scaled features)."""
        spec, names = self.spec, self.getOrDefault("features")
        rows = panel_features(panel, spec, self.getOrDefault("imputeOnLoad"), self.getOrDefault("scoreAfterClip"),
                              medians=self.getOrDefault("medians"))
        long = cut_windows(rows, spec, names, self.getOrDefault("window"))
        scaled = {f: (F.col(f) - X.dlit(c)) / X.dlit(s) for f, c, s in
                  zip(names, self.getOrDefault("centers"), self.getOrDefault("scales"), strict=True)}
        return long.withColumns(scaled).select(spec.entity, "step", "is_pad", *names)

    def _transform(self, panel: DataFrame) -> DataFrame:
        spec, names = self.spec, self.getOrDefault("features")
        long = self.long_windows(panel)
        if self.getOrDefault("output") == "long":
            return long
        flat = flatten_window(window_arrays(long, spec, names))
        out = to_vector(flat, out=self.getOrDefault("outputCol")).select(spec.entity, self.getOrDefault("outputCol"))
        if spec.label and present(panel.columns, [spec.label]):
            labels = last_label(panel, spec, "__y").select(spec.entity, F.col("__y").cast("double").alias("label"))
            out = out.join(labels, spec.entity)
        return out
