"""Boosted trees on packed blocks against MLlib's own fit, which has the same method."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import boosting, models


@pytest.fixture(scope="module")
def few_values(spark):
    """Features of few values, zeros and negative ones among them, as sparse and dense vectors: bins are the same for any fit."""
    rng = np.random.default_rng(3)
    n = 4000
    x = {"a": rng.integers(-5, 20, n), "b": rng.integers(-9, 1, n), "c": rng.integers(0, 2, n), "d": (rng.random(n) < 0.1) * rng.integers(1, 4, n),
         "e": np.zeros(n), "f": -(rng.random(n) < 0.3).astype(int)}
    z = 0.2 * x["a"] - 0.4 * x["b"] * x["c"] + x["d"] + 2 * x["f"] - 2
    pdf = pd.DataFrame({"id": range(n), **{k: v.astype(float) for k, v in x.items()}, "y": (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)})
    rows = spark.createDataFrame(pdf).repartition(3).sortWithinPartitions("id")
    return VectorAssembler(inputCols=list(x), outputCol="features").transform(rows).select("id", "y", "features").persist()


def scores(model, rows):
    return dict(model.transform(rows).select("id", vector_to_array("rawPrediction")[1]).collect())


@pytest.mark.parametrize("in_one, parts", [(True, 3), (True, 1), (False, 3)])
def test_same_trees_as_mllib(few_values, in_one, parts, monkeypatch):
    """Rounds, gains and margins are MLlib's, from one block as from several, also over a cut lineage and levels in several jobs."""
    few_values = few_values.coalesce(parts)
    settings = {"featuresCol": "features", "labelCol": "y", "maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 7, "seed": 5}
    if not in_one:
        monkeypatch.setattr(boosting, "ROWS_PER_TASK", 10)
        monkeypatch.setattr(boosting, "ROUNDS_PER_LINEAGE", 3)
        monkeypatch.setattr(boosting, "BYTES_PER_JOB", 10_000)
    want = GBTClassifier(**settings).fit(few_values)
    got = boosting.BoostedTrees(**settings).fit(few_values)
    a, b = scores(want, few_values), scores(got, few_values)
    assert len(a) == 4000 and max(abs(a[i] - b[i]) for i in a) < 1e-9
    assert got.totalNumNodes == want.totalNumNodes and got.treeWeights == want.treeWeights
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)


def test_blocks_hold_entries_other_than_zero(few_values):
    """Bins of zero and negative values; a row has as many lines as it has entries in other bins than that of zero."""
    rows = few_values.select(F.col("features").alias("x"), F.col("y").cast("double"))
    bins, n = boosting.find_bins(rows, 6, 32)
    assert n == 4000 and bins.upper[bins.off[:-1]].tolist()[2:] == [0.5, 0.5, np.inf, -0.5]
    assert (bins.zero - bins.off[:-1]).tolist() == [5, 9, 0, 0, 0, 1]
    import pickle

    blocks = [pickle.loads(r["block"]) for r in rows.mapInArrow(boosting._packed(bins), "block binary").collect()]
    assert sorted(b.part for b in blocks) == [0, 1, 2] and sum(len(b.y) for b in blocks) == 4000 and max(len(b.lines) for b in blocks) == 5


def test_draws_of_rows_and_columns(few_values):
    """A share of the rows and of the columns a node: the same seed gives the same model, another one another, and all rank well."""
    from riskloom.operators.evaluate import evaluate

    build = lambda seed: models.boosted({"n_estimators": 5, "max_depth": 3, "subsample": 0.6, "colsample_bytree": 0.5}, 4000, "y", seed)
    one, again, other = (build(s).fit(few_values) for s in (1, 1, 2))
    assert scores(one, few_values) == scores(again, few_values) != scores(other, few_values)
    held = one.transform(few_values).select("y", vector_to_array("probability")[1].alias("score"))
    assert evaluate(held, "y", "score").first()["roc_auc"] > 0.8


def test_labels_and_empty_tables(few_values):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        models.boosted({"n_estimators": 1}, 1, "y", 1).fit(few_values.withColumn("y", F.lit(2)))
    with pytest.raises(ValueError, match="no rows"):
        models.boosted({"n_estimators": 1}, 1, "y", 1).fit(few_values.filter("id < 0"))


def test_bins_of_many_values_hold_equal_shares():
    rng = np.random.default_rng(0)
    values = np.sort(rng.normal(size=50_000))
    ends = boosting._upper(values, np.ones(50_000), 32)
    assert len(ends) == 31 and np.abs(np.diff(np.searchsorted(values, ends)) - 50_000 / 32).max() <= 1


def test_the_registered_experiment_searches(spark, folder, monkeypatch):
    """All steps of the configured run: 50 trials of 5 folds, unless ten bring nothing, then folds, final fits, test, oot and etrc rows."""
    from riskloom.catalog import modelling

    class Seen(Exception):
        pass

    def asked(train_df, label, keys, config, test_df, others):
        assert config.tuning and config.trials == 50 and config.k == 5 and config.oof and config.seed == 42
        assert set(config.models) == {"LightGBM", "XGBoost", "LogisticRegression"} and not config.spaces and not config.params
        assert set(others) == {"oot", "etrc"}
        raise Seen

    monkeypatch.setattr(modelling.J, "run_experiment", asked)
    with pytest.raises(Seen):
        modelling.experiment_run(spark, folder)
