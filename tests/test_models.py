"""MLlib models: rank quality, determinism, persistence and explanations, not coefficients."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import explain, models, preprocess
from riskloom.operators.target import stratified_folds, stratified_split
from riskloom.sources.artifacts import load_metadata, load_model, score_table

SMALL = {"RandomForest": {"n_estimators": 10, "max_depth": 4}, "LightGBM": {"n_estimators": 3, "num_leaves": 4}}


@pytest.fixture(scope="module")
def planted(spark):
    """A signal in one number and one category, noise in another, some nulls."""
    rng = np.random.default_rng(0)
    n = 1500
    x, noise = rng.normal(size=n), rng.normal(size=n)
    c = rng.choice(["low", "mid", "high"], n)
    z = 2 * x + np.where(c == "high", 1.5, 0) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    pdf = pd.DataFrame({"id": range(n), "x": np.where(rng.random(n) < 0.05, np.nan, x), "noise": noise, "c": c, "y": y})
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def trained(planted):
    split = stratified_split(planted, "y", ["id"])
    return models.train(split, "y", models=("LogisticRegression", "RandomForest", "LightGBM", "nonsense"), params=SMALL, keep=["id"])


def test_training(trained, planted):
    assert set(trained.failures) == {"nonsense"}
    m = {(r["model"], r["split"]): r["roc_auc"] for r in trained.metrics.collect()}
    assert len(m) == 12 and all(v > 0.75 for v in m.values())
    assert trained.scored.count() == 3 * planted.count()
    top = trained.importance(3).filter("rank = 1").collect()
    assert {r["feature"] for r in top} == {"x"}
    assert [r["rank"] for r in trained.leaderboard().collect()] == [1, 2, 3]


def test_same_seed_same_scores(planted, trained):
    split = stratified_split(planted, "y", ["id"])
    again = models.train(split, "y", models=("RandomForest",), params=SMALL, keep=["id"])
    a = trained.scored.filter("model = 'RandomForest'").select("id", F.col("score").alias("a"))
    assert again.scored.join(a, "id").filter("abs(score - a) > 1e-12").count() == 0


def test_save_and_load(spark, planted, trained, tmp_path):
    path = f"{tmp_path}/lr"
    trained.pipelines["LogisticRegression"].write().save(path)
    from pyspark.ml import PipelineModel

    odd = spark.createDataFrame([(1, None, 0.5, "unseen"), (2, 1.0, None, None)], "id int, x double, noise double, c string")
    a = score_table(trained.pipelines["LogisticRegression"], odd, ["id"]).collect()
    b = score_table(PipelineModel.load(path), odd, ["id"]).collect()
    assert a == b and all(0 < r["score"] < 1 for r in a)


def test_unknown_level_is_all_zero(spark, planted):
    prep = preprocess.fit_preprocessor(planted, ["x"], ["c"])
    odd = spark.createDataFrame([(0.0, "unseen"), (0.0, "high")], "x double, c string")
    from pyspark.ml.functions import vector_to_array

    got = [r["f"][1:] for r in prep.transform(odd).select(vector_to_array("features").alias("f")).collect()]
    assert preprocess.feature_names(prep) == ["num__x", "cat__c_high", "cat__c_low", "cat__c_mid"]
    assert got == [[0, 0, 0], [1, 0, 0]]


def test_search_and_folds(planted):
    folded = stratified_folds(planted, "y", ["id"], 3)
    _, table = models.assemble(folded, "y", folded, ["id", "fold"])
    found = models.quick_tune(table, "y", "LogisticRegression", n_trials=2, k=3, fixed={"max_iter": 20})
    assert len(found.trials) == 2 and len(found.cv_scores) == 3 and found.best_score > 0.8
    assert found.best_score == pytest.approx(np.mean(found.cv_scores)) and found.best_std == pytest.approx(np.std(found.cv_scores))
    again = models.quick_tune(table, "y", "LogisticRegression", n_trials=2, k=3, fixed={"max_iter": 20})
    assert again.best_params == found.best_params
    stopped = models.tune(table, "y", "LogisticRegression", n_trials=9, k=3, patience=1, min_gain=1.0, fixed={"max_iter": 5})
    assert len(stopped.trials) == 2
    table.unpersist()


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForest", "GradientBoosting"])
def test_folds_of_a_search_keep_scores_alone(planted, name, monkeypatch):
    """A trial ranks scores, so it neither computes nor keeps predictions; the scores are the same."""
    folded = stratified_folds(planted, "y", ["id"], 2)
    _, table = models.assemble(folded, "y", folded, ["id", "fold"])
    params = {"n_estimators": 3, "max_depth": 3}
    whole, alone = (models.out_of_fold(table, "y", name, params, k=2, keep=["id"], pred=pred) for pred in (True, False))
    assert alone.columns == ["id", "y", "fold", "score"]
    assert {r["id"]: r["score"] for r in alone.collect()} == {r["id"]: r["score"] for r in whole.collect()}
    seen = []
    monkeypatch.setattr(models, "fold_scores", lambda held, *a: seen.append(held.columns) or [0.5, 0.5])
    models.cross_validate(table, "y", name, params, k=2)
    assert seen == [["y", "fold", "score"]]
    table.unpersist()


def test_search_spaces():
    import random

    rng = random.Random(1)
    for name, spec in models.MODELS.items():
        for _ in range(30):
            p = models.sample_params(spec.space, rng)
            for k, v in p.items():
                s = spec.space[k]
                assert v in s["choices"] if s["type"] == "categorical" else s["low"] <= v <= s["high"]
            if name == "LogisticRegression":
                assert ("l1_ratio" in p) == (p["penalty"] == "elasticnet")
            spec.build({**spec.defaults, **p}, 100, "y", 1)


def test_experiment(spark, planted, tmp_path):
    split = stratified_split(planted, "y", ["id"])
    part = lambda s: split.filter(F.col("split") == s).drop("split")
    config = models.RunConfig(models=("LogisticRegression", "nonsense"), k=3, tuning=False,
                              params={"LogisticRegression": {"max_iter": 20}}, artifact_dir=str(tmp_path))
    run = models.run_experiment(part("train"), "y", ["id"], config, part("test"))
    row = run.leaderboard.first()
    assert row["model"] == "LogisticRegression" and row["rank"] == 1 and row["test_auc"] > 0.8 and 0 < row["cv_auc_std"] < 0.1
    assert set(run.failures) == {"nonsense"} and run.oof.count() == part("train").count()
    meta = load_metadata(spark, run.path).first()
    assert len(meta["cv_scores"]) == 3 and meta["test_metrics"]["test_auc"] == pytest.approx(row["test_auc"])
    assert load_model(run.path, "LogisticRegression").transform(part("test")).count() == part("test").count()


def test_experiment_scores_every_split(planted):
    split = stratified_split(planted, "y", ["id"])
    part = lambda s: split.filter(F.col("split") == s).drop("split")
    config = models.RunConfig(models=("LogisticRegression",), k=2, tuning=False, params={"LogisticRegression": {"max_iter": 5}})
    run = models.run_experiment(part("train"), "y", ["id"], config, part("test"), others={s: part(s) for s in ("oot", "etrc")})
    assert {r["split"]: r["roc_auc"] > 0.8 for r in run.other_metrics.collect()} == {"oot": True, "etrc": True}


def test_linear_explanation_is_additive(trained):
    lr = trained.classifiers["LogisticRegression"]
    names = trained.names
    from pyspark.ml.functions import vector_to_array

    wide = trained.table.select("id", "features", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(names)])
    coef = dict(zip(names, [float(v) for v in lr.coefficients]))
    centre = explain.means(explain.background(wide, names, ["id"]))
    e = explain.linear(wide, ["id"], coef, float(lr.intercept), centre)
    raw = lr.transform(wide).select("id", vector_to_array("rawPrediction")[1].alias("raw"))
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"])
    assert e.withColumn("total", total).join(raw, "id").filter("abs(total - raw) > 1e-9 or abs(prediction - raw) > 1e-9").count() == 0
    assert explain.global_importance(e).first()["feature"] == "num__x"
    top = explain.top_contributors(e, ["id"], 2).first()
    assert len(top["top_positive"]) <= 2 and all(r["contribution"] > 0 for r in top["top_positive"])
    with pytest.raises(ValueError):
        explain.dependence_data(e, ["id"], "nope", names)


@pytest.mark.parametrize("method", [explain.EXACT, explain.PERMUTATION])
def test_agnostic_explanation_of_a_forest(trained, method):
    """Exact sets and sampled permutations: both add up, and say which they are."""
    names = trained.names
    from pyspark.ml.functions import vector_to_array

    wide = trained.table.select("id", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(names)]).filter("id < 20")
    forest = trained.classifiers["RandomForest"]

    def score(df):
        ready = df.withColumn("features", array_to_vector(F.array(*names)))
        return forest.transform(ready).withColumn("score", vector_to_array("probability")[1])

    rows = explain.background(wide, names, ["id"], n=5)
    e = explain.agnostic(wide, ["id"], names, score, rows, n_permutations=4, method=method)
    assert e.filter(F.col("method") != method).count() == 0
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"])
    assert e.withColumn("gap", F.abs(total - F.col("prediction"))).filter("gap > 1e-9").count() == 0
    assert explain.global_importance(e).first()["feature"] == "num__x"


def test_coalition_weights():
    for d, method in ((3, explain.EXACT), (12, explain.EXACT), (3, explain.PERMUTATION), (12, explain.PERMUTATION)):
        w = explain.coalition_weights(d, 6, 1, method)
        assert len(w) == 2**d if method == explain.EXACT else len(w) <= 6 * (d + 1)
        for j in range(d):
            assert sum(v[j] for v in w.values()) == pytest.approx(0)
        assert [sum(v) for m, v in w.items() if all(m)] == pytest.approx([1])


def test_a_column_of_fifty_thousand_levels_trains(spark):
    rows = spark.range(100_000).select(
        "id", (F.col("id") % 50_000).cast("string").alias("wide"), (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") % 50_000) % 2).cast("int").alias("y"), F.lit("train").alias("split"))
    run = models.train(rows, "y", models=("LogisticRegression",), params={"LogisticRegression": {"max_iter": 20}}, keep=["id"])
    assert len(run.names) == 1 + preprocess.HASH_SLOTS and run.names[1] == "cat__wide#0"
    assert run.metrics.first()["roc_auc"] > 0.55  # far beyond what the other column gives
    run.release()


def test_killed_run_takes_up_what_is_done(planted, tmp_path, monkeypatch):
    """The first run loses a fold and the final fit; the second fits these two alone, and the board is that of a run in one go."""
    import dataclasses

    spec, fits, broken = models.MODELS["LogisticRegression"], [], [True]

    def build(p, rows, label, seed):
        fits.append(rows)
        if broken[0] and len(fits) in (1, 3):
            raise RuntimeError("killed")
        return spec.build(p, rows, label, seed)

    monkeypatch.setitem(models.MODELS, "LogisticRegression", dataclasses.replace(spec, build=build))
    config = models.RunConfig(models=("LogisticRegression",), k=3, tuning=False, params={"LogisticRegression": {"max_iter": 5}}, artifact_dir=str(tmp_path), parallelism=1)
    go = lambda **kw: models.run_experiment(planted, "y", ["id"], config, planted, **kw)
    with pytest.raises(RuntimeError):
        go(experiment_id="one")
    assert len(fits) == 4
    broken[0] = False
    run = go(experiment_id="one")
    assert len(fits) == 6
    drop = ("training_time_s", "model_id")
    assert run.leaderboard.drop(*drop).collect() == go().leaderboard.drop(*drop).collect()
    other = dataclasses.replace(config, k=2)
    with pytest.raises(ValueError, match="another run"):
        models.run_experiment(planted, "y", ["id"], other, planted, experiment_id="one")


def test_failed_search_has_a_row(planted):
    folded = stratified_folds(planted, "y", ["id"], 2)
    _, table = models.assemble(folded, "y", folded, ["id", "fold"])
    found = models.tune_multiple(table, "y", ["LogisticRegression", "nonsense"], n_trials=1, k=2, fixed={"max_iter": 3})
    rows = {r["model"]: (r["status"], r["error"] is None) for r in found.status(planted.sparkSession).collect()}
    assert rows == {"LogisticRegression": ("searched", True), "nonsense": ("failed", False)}
    table.unpersist()


@pytest.mark.parametrize("params, depth", [
    ({"max_depth": 6}, 6), ({"max_depth": -1, "num_leaves": 31}, 5), ({"max_depth": 10, "num_leaves": 15}, 4), ({"max_depth": 3, "num_leaves": 127}, 3)])
def test_leaves_bound_the_depth(params, depth):
    assert models.boosted(params, 100, "y", 1).getMaxDepth() == depth


def test_boosting_parameters_reach_the_estimator():
    for name, want in {"XGBoost": (200, 6, 0.8, "0.8", 1), "LightGBM": (200, 5, 1.0, "all", 20)}.items():
        e = models.boosted(models.MODELS[name].live, 100, "y", 1)
        assert (e.getMaxIter(), e.getMaxDepth(), e.getSubsamplingRate(), e.getFeatureSubsetStrategy(), e.getMinInstancesPerNode()) == want


@pytest.mark.parametrize("kind", ["WOEStage", "TargetStage", "SmartStage"])
def test_encoders_are_stages_of_a_saved_pipeline(spark, planted, tmp_path, kind, monkeypatch):
    """Encoder, assembler and classifier: fitted, saved, loaded, and raw rows score alike, also with tables that are not held locally."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from riskloom.operators import stages

    raw = planted.withColumn("x", F.coalesce(F.nanvl("x", F.lit(None)), F.lit(0.0))).withColumn("wide", (F.col("id") % 60).cast("string"))
    inputs = ["c", "wide"] if kind != "WOEStage" else ["c", "x", "wide"]
    stage = getattr(stages, kind)(inputCols=inputs, labelCol="y")
    fitted = stage.fit(raw)
    pipe = Pipeline(stages=[stage, VectorAssembler(inputCols=fitted.outputs(), outputCol="features"), LogisticRegression(labelCol="y", maxIter=5)])
    pipe.write().save(str(tmp_path / "plan"))
    model = Pipeline.load(str(tmp_path / "plan")).fit(raw)
    model.write().save(str(tmp_path / "model"))
    odd = raw.select("id", "x", F.when(F.col("id") % 3 > 0, F.col("c")).alias("c"), F.when(F.col("id") % 5 > 0, F.concat("wide", F.lit("z"))).otherwise(F.col("wide")).alias("wide"))
    want = score_table(model, odd, ["id"]).orderBy("id").collect()
    assert score_table(load_model_of(tmp_path), odd, ["id"]).orderBy("id").collect() == want
    monkeypatch.setattr(stages, "BROADCAST_ROWS", 1)
    assert score_table(PipelineModel.load(str(tmp_path / "model")), odd, ["id"]).orderBy("id").collect() == want
    again = PipelineModel.load(str(tmp_path / "model")).stages[0]
    assert again.uid == model.stages[0].uid and again.getInputCols() == inputs and again.getLabelCol() == "y"


def load_model_of(folder):
    import shutil

    shutil.copytree(folder / "model", folder / "run" / "models" / "one")
    return load_model(str(folder / "run"), "one")


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForest", "LightGBM"])
def test_fitted_models_are_explained_by_source_column(trained, name):
    """Two numbers and one category: three players, whole slots at a time; chunks change nothing."""
    few = trained.table.filter("id < 30")
    e = explain.explain_model(trained, name, ["id"], few, n_background=10, n_permutations=6)
    rows = {r["id"]: r for r in e.collect()}
    assert len(rows) == 30
    scores = {r["id"]: r["score"] for r in trained.scored.filter(F.col("model") == name).filter("id < 30").collect()}
    for i, r in rows.items():
        assert [c["feature"] for c in r["contributions"]] == ["x", "noise", "c"]
        assert r["prediction"] == pytest.approx(scores[i])
        assert r["base_value"] + sum(c["contribution"] for c in r["contributions"]) == pytest.approx(scores[i])
        assert r["contributions"][2]["value"] in (0.0, 1.0, 2.0)
    assert len({round(r["base_value"], 12) for r in rows.values()}) == 1
    parts = explain.explain_model(trained, name, ["id"], few, n_background=10, n_permutations=6, chunks=3).collect()
    assert {r["id"]: r["contributions"] for r in parts} == {i: r["contributions"] for i, r in rows.items()}
    assert explain.global_importance(e).first()["feature"] == "x"
    with pytest.raises(ValueError):
        explain.explain_model(trained, "nonsense", ["id"])


def test_raw_table_to_board(planted):
    from riskloom.operators.workflow import run_workflow

    raw = planted.select("id", "x", "noise", "c", F.lit("same").alias("constant"), F.concat(F.lit("r"), "id").alias("row_code"),
                         F.when(F.col("y") == 1, "bad").otherwise("good").alias("outcome"))
    out = run_workflow(raw, "outcome", ["id"], positive_class="bad", models=("LogisticRegression",), params={"LogisticRegression": {"max_iter": 10}})
    assert out.dropped == {"constant": "constant", "row_code": "identifier"}
    assert {r["class"]: r["n"] for r in out.balance.collect()} == {str(r["y"]): r["count"] for r in planted.groupBy("y").count().collect()}
    assert {r["column"] for r in out.features.collect()} == {"x", "noise", "c"}
    assert out.summary.first()["n_features"] == 3 and out.summary.first()["n_rows"] == planted.count()
    assert out.training.leaderboard().first()["roc_auc"] > 0.8
    ends = out.training.roc().groupBy("split").agg(F.min("fpr").alias("a"), F.max("tpr").alias("b")).collect()
    assert {(r["a"], r["b"]) for r in ends} == {(0.0, 1.0)} and len(ends) == 4
    out.release()
    with pytest.raises(ValueError, match="not found"):
        run_workflow(raw, "nothing", ["id"])


def test_a_table_of_one_split_is_fitted_on_all_slots(spark):
    one = spark.range(200_000).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 2).cast("int").alias("y")).coalesce(1)
    _, table = models.assemble(one, "y", one, ["id"])
    sizes = [r["n"] for r in table.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    slots = spark.sparkContext.defaultParallelism
    assert len(sizes) == min(slots, 8) and sum(sizes) == 200_000 and max(sizes) < 2 * min(sizes)
    table.unpersist()


def test_rows_of_a_training_are_scored_once(trained):
    assert trained.scored.is_cached and trained.table.is_cached


def test_models_of_the_same_settings_share_their_fits(planted, monkeypatch):
    folded = stratified_folds(planted, "y", ["id"], 2)
    _, table = models.assemble(folded, "y", folded, ["id", "fold"])
    fits = []

    def build(p, rows, label, seed):
        made = models.boosted(p, rows, label, seed)
        fit = made.fit
        made.fit = lambda part: fits.append(p) or fit(part)
        return made

    presets = {"A": {"n_estimators": 2, "max_depth": 2}, "B": {"n_estimators": 2, "num_leaves": 3, "max_depth": -1}, "C": {"n_estimators": 1, "max_depth": 2}}
    for name, defaults in presets.items():
        monkeypatch.setitem(models.MODELS, name, models.ModelSpec(build, {}, defaults))
    held = models.cross_validate_models(table, "y", tuple(presets), k=2, keep=["id"])
    scores = {m: {r["id"]: r["score"] for r in held.filter(F.col("model") == m).collect()} for m in presets}
    assert len(fits) == 4 and scores["A"] == scores["B"] != scores["C"]
    assert all(len(s) == planted.count() for s in scores.values())
    table.unpersist()


def test_explained_rows_are_dealt_over_all_slots(spark, trained, planted):
    e = explain.explain_model(trained, "LightGBM", ["id"], n_background=3, n_permutations=2)
    assert trained.table.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism <= e.rdd.getNumPartitions()
    assert e.count() == planted.count()


def test_forests_keep_node_ids_while_these_are_small(planted):
    """Ids of nodes kept between levels are a matter of cost: the trees are those of a forest without them."""
    build = models.MODELS["RandomForest"].build
    asked = {"n_estimators": 20, "max_depth": 6}
    kept = build(asked, 1500, "y", 7)
    assert kept.getCacheNodeIds()
    assert not build(asked, models.NODE_IDS // 20 + 1, "y", 7).getCacheNodeIds()  # they would outgrow their bound
    assert not build({"n_estimators": 1}, 1500, "y", 7).getCacheNodeIds()
    _, table = models.assemble(planted, "y", planted, ["id"])
    trees = [e.fit(table).toDebugString.split("\n", 1)[1] for e in (kept, kept.copy({kept.cacheNodeIds: False}))]
    assert trees[0] == trees[1]
    table.unpersist()


@pytest.mark.parametrize("slot, at_once", [(1, 1), (10**9, 2)])
def test_fits_of_trees_side_by_side_keep_bounded_rows(planted, tmp_path, monkeypatch, slot, at_once):
    """A fit of trees keeps its rows in memory: on many rows fits go one at a time, and the board is the same."""
    import threading
    import time

    monkeypatch.setattr(models, "TREE_BYTES_PER_SLOT", slot)
    now, most, lock = set(), [], threading.Lock()

    def build(p, rows, label, seed):
        made = models.forest(p, rows, label, seed)
        fit = made.fit

        def watched(part):
            with lock:
                now.add(id(made))
                most.append(len(now))
            time.sleep(0.3)
            try:
                return fit(part)
            finally:
                with lock:
                    now.discard(id(made))

        made.fit = watched
        return made

    monkeypatch.setitem(models.MODELS, "F", models.ModelSpec(build, {}, {"n_estimators": 1, "max_depth": 2, "bootstrap": False, "max_features": None}))
    config = models.RunConfig(models=("F",), k=3, trials=1, spaces={"F": {}}, artifact_dir=str(tmp_path), parallelism=2)
    run = models.run_experiment(planted, "y", ["id"], config, planted)
    assert len(most) == 7 and max(most) == at_once
    monkeypatch.undo()
    plain = models.train(planted.withColumn("split", F.lit("train")), "y", models=("RandomForest",), keep=["id"],
                         params={"RandomForest": {"n_estimators": 1, "max_depth": 2, "min_samples_split": 2, "bootstrap": False, "max_features": None}})
    assert run.leaderboard.first()["test_auc"] == plain.metrics.first()["roc_auc"]
    run.release()
    plain.release()
