"""The fitted panel transformer: save, load, score another panel; as a stage of a pipeline."""
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from conftest import SF
from tessera.config import PanelSpec
from tessera.operators import splits, windows
from tessera.operators.panel_model import PanelPreprocessor, PanelPreprocessorModel
from tessera.sources import fixtures as fx


def rows(df):
    return sorted(map(str, df.collect()))


def test_equals_prepare_windows_on_its_own_panel(spark):
    p = fx.panel_short(spark, SF)
    long, _, stats, names = windows.prepare_windows(p)
    model = PanelPreprocessor(output="long").fit(p)
    assert rows(model.transform(p).select(*long.select("patient_id", "step", "is_pad", *names).columns)) == \
        rows(long.select("patient_id", "step", "is_pad", *names))
    assert model.getOrDefault("features") == names
    assert dict(zip(names, model.getOrDefault("centers"), strict=True)) == {r.feature: r.center for r in stats.collect()}


@pytest.mark.parametrize("how", [{"imputeOnLoad": False}, {"featureMode": "raw", "includePadding": True, "scoreAfterClip": True, "window": 3}])
def test_loaded_model_equals_the_fitted_one(spark, scratch, how):
    p = fx.panel_short(spark, SF)
    train, test = (splits.take_split(p, "patient_id", w) for w in ("train", "test"))
    model = PanelPreprocessor(PanelSpec(), **how).fit(train)
    model.write().save(f"{scratch}/model")
    loaded = PanelPreprocessorModel.load(f"{scratch}/model")
    odd = test.drop("wbc").withColumns({"lactate": F.lit(None).cast("double"), "features": F.lit("x"), "extra": F.lit(1.0)})
    assert rows(loaded.transform(odd)) == rows(model.transform(odd)) and model.transform(odd).count() == test.select("patient_id").distinct().count()


def test_statistics_are_the_training_panels(spark):
    p = fx.panel_short(spark, SF)
    model = PanelPreprocessor(output="long").fit(p)
    some = p.where("patient_id % 7 = 0")
    alone, among = (model.transform(d).where("patient_id % 7 = 0") for d in (some, p))
    assert rows(alone) == rows(among)  # a patient's windows do not depend on who is scored with them
    empty = model.transform(p.where("false"))
    assert empty.collect() == []


def test_pipeline_from_raw_panel_to_scores(spark, scratch):
    p = fx.panel_short(spark, SF)
    pipe = Pipeline(stages=[PanelPreprocessor(), LogisticRegression(maxIter=5)]).fit(splits.take_split(p, "patient_id", "train"))
    pipe.write().save(f"{scratch}/pipe")
    test = splits.take_split(p, "patient_id", "test").drop("label")
    got = PipelineModel.load(f"{scratch}/pipe").transform(test)
    assert rows(got.select("patient_id", "probability")) == rows(pipe.transform(test).select("patient_id", "probability"))
