"""Explanations of models that are sums, against the same sets and background rows scored one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain, models


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(4)
    n = 600
    x, z = rng.normal(size=n).round(1), rng.integers(0, 4, n).astype(float)
    c = rng.choice(["low", "mid", "high"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x + (c == "high") - z / 2)))).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(n), "x": x, "z": z, "c": c, "y": y})).withColumn("split", F.lit("train"))
    params = {"LogisticRegression": {"max_iter": 20}, "RandomForest": {"n_estimators": 4, "max_depth": 5}, "XGBoost": {"n_estimators": 4}}
    return models.train(rows, "y", models=tuple(params), params=params, keep=["id"])


@pytest.mark.parametrize("method", [explain.PERMUTATION, explain.EXACT])
@pytest.mark.parametrize("name, output", [("LogisticRegression", "margin"), ("RandomForest", "margin"), ("RandomForest", "probability"), ("XGBoost", "margin")])
def test_sums_are_the_means_over_mixtures(trained, name, output, method, monkeypatch):
    few = trained.table.filter("id < 40")
    go = lambda: {r["id"]: r for r in explain.explain_model(trained, name, ["id"], few, n_background=7, n_permutations=4, output=output, method=method).collect()}
    fast = explain.explain_model(trained, name, ["id"], few, n_background=7, output=output)._jdf.queryExecution().toString()
    assert "Generate" not in fast and "MapInArrow" in fast
    monkeypatch.setattr(explain, "CELLS_AT_ONCE", 50)
    got = go()
    monkeypatch.setattr(explain, "_additive", lambda *a: None)
    want = go()
    assert len(got) == len(want) == 40
    for i, w in want.items():
        g = got[i]
        assert (g["prediction"], g["base_value"], g["method"]) == (pytest.approx(w["prediction"]), pytest.approx(w["base_value"]), w["method"])
        assert [(c["feature"], c["value"]) for c in g["contributions"]] == [(c["feature"], c["value"]) for c in w["contributions"]]
        assert [c["contribution"] for c in g["contributions"]] == pytest.approx([c["contribution"] for c in w["contributions"]], abs=1e-12)


def test_a_probability_of_a_margin_is_no_sum(trained):
    plan = explain.explain_model(trained, "XGBoost", ["id"], n_background=3)._jdf.queryExecution().toString()
    assert "Generate" in plan and "MapInArrow" not in plan
