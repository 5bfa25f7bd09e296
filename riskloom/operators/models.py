"""Binary classifiers on MLlib: training, cross-validation, search, experiments.

Independent fits run side by side from a driver thread pool over one persisted table of
assembled features; rows never leave the executors.
"""

from __future__ import annotations

import logging
import math
import random
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rows import local_table
from ..session import fresh_path, settle, shared_dir
from ..sources.artifacts import save_experiment, with_score
from ..sources.ledger import Ledger
from .boosting import BoostedTrees
from .evaluate import cv_leaderboard, evaluate, leaderboard, roc_curve
from .preprocess import _quote, feature_names, fit_preprocessor, plain_name
from .target import stratified_folds

log = logging.getLogger(__name__)

FEATURES = "features"
MAX_DEPTH = 30  # MLlib's own limit


# -- estimators -------------------------------------------------------------------

def logistic(p: Mapping, rows: int, label: str, seed: int):
    """Penalty strength ``C`` counts summed loss; MLlib averages it, hence ``1 / (C n)``."""
    penalty = p.get("penalty", "l2")
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": float(p.get("l1_ratio", 0.5))}.get(penalty, 0.0)
    strength = 0.0 if penalty is None else 1.0 / (float(p.get("C", 1.0)) * max(rows, 1))
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=label, maxIter=int(p.get("max_iter", 400)), regParam=strength,
        elasticNetParam=mix, standardization=False,
    )


def _depth(asked: int) -> int:
    if asked > MAX_DEPTH:
        raise ValueError(f"max_depth {asked} is beyond {MAX_DEPTH}")
    return asked


def _leaf(p: Mapping) -> int:
    # a node of fewer than min_samples_split rows is not split: its halves hold at least half of it
    return max(int(p.get("min_samples_leaf", 1)), math.ceil(int(p.get("min_samples_split", 2)) / 2))


# A forest keeps the node of each row in each tree between levels, instead of walking every tree from its root at every
# level, where there are trees enough to gain by it and while these ids take at most 1 GiB. The trees are the same.
NODE_ID_TREES, NODE_IDS = 20, 2**28


def forest(p: Mapping, rows: int, label: str, seed: int):
    subset = {"sqrt": "sqrt", "log2": "log2", None: "all"}[p.get("max_features", "sqrt")]
    trees = int(p.get("n_estimators", 200))
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=label, numTrees=trees, cacheNodeIds=trees >= NODE_ID_TREES and rows * trees <= NODE_IDS,
        maxDepth=_depth(int(p.get("max_depth", 10))), minInstancesPerNode=_leaf(p),
        featureSubsetStrategy=subset, impurity=p.get("criterion", "gini"), bootstrap=bool(p.get("bootstrap", True)), seed=seed,
    )


def boosted(p: Mapping, rows: int, label: str, seed: int):
    depth = int(p.get("max_depth", 5))
    if depth <= 0 or "num_leaves" in p:  # trees grow by levels: so many leaves bound the depth, next to a depth that is set
        by_leaves = math.ceil(math.log2(int(p.get("num_leaves", 31)) + 1))
        depth = min(depth, by_leaves) if depth > 0 else by_leaves
    leaf = p.get("min_child_samples") or p.get("min_child_weight") or _leaf(p)
    columns = float(p.get("colsample_bytree", 1.0))
    return BoostedTrees(
        featuresCol=FEATURES, labelCol=label, maxIter=int(p.get("n_estimators", 100)),
        stepSize=float(p.get("learning_rate", 0.1)), maxDepth=_depth(depth), minInstancesPerNode=int(leaf),
        subsamplingRate=float(p.get("subsample", 1.0)), featureSubsetStrategy="all" if columns >= 1 else str(columns), seed=seed,
    )


@dataclass(frozen=True)
class ModelSpec:
    """How to build an estimator, its live and library defaults, and what a search may vary."""

    build: Callable
    live: Mapping
    defaults: Mapping
    space: Mapping = field(default_factory=dict)


def _int(low, high):
    return {"type": "int", "low": low, "high": high}


def _float(low, high, log=False):
    return {"type": "float", "low": low, "high": high, "log": log}


def _choice(*values):
    return {"type": "categorical", "choices": list(values)}


# Presets and search ranges. The two boosted presets stand in for native
# learners: MLlib has neither second-order boosting nor their L1, L2 and gamma terms.
MODELS: dict[str, ModelSpec] = {
    "LogisticRegression": ModelSpec(
        logistic, {"max_iter": 400}, {"max_iter": 1000},
        {"C": _float(0.001, 100.0, True), "penalty": _choice("l1", "l2", "elasticnet", None),
         "l1_ratio": {**_float(0.0, 1.0), "when": ("penalty", "elasticnet")}},
    ),
    "RandomForest": ModelSpec(
        forest, {"n_estimators": 200, "max_depth": 10, "min_samples_split": 5},
        {"n_estimators": 100, "max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2},
        {"n_estimators": _int(50, 500), "max_depth": _int(3, 20), "min_samples_split": _int(2, 20),
         "min_samples_leaf": _int(1, 10), "max_features": _choice("sqrt", "log2", None), "criterion": _choice("gini", "entropy")},
    ),
    "GradientBoosting": ModelSpec(
        boosted, {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
        {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
        {"n_estimators": _int(50, 500), "learning_rate": _float(0.01, 0.3, True), "max_depth": _int(2, 10),
         "min_samples_split": _int(2, 20), "min_samples_leaf": _int(1, 10), "subsample": _float(0.6, 1.0)},
    ),
    "XGBoost": ModelSpec(
        boosted, {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 6, "subsample": 0.8, "colsample_bytree": 0.8},
        {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
        {"n_estimators": _int(50, 500), "learning_rate": _float(0.01, 0.3, True), "max_depth": _int(2, 12),
         "min_child_weight": _int(1, 10), "subsample": _float(0.5, 1.0), "colsample_bytree": _float(0.5, 1.0)},
    ),
    "LightGBM": ModelSpec(
        boosted, {"n_estimators": 200, "learning_rate": 0.1, "max_depth": -1, "num_leaves": 31, "min_child_samples": 20},
        {"n_estimators": 100, "learning_rate": 0.1, "max_depth": -1, "num_leaves": 31},
        {"n_estimators": _int(50, 500), "learning_rate": _float(0.01, 0.3, True), "num_leaves": _int(15, 127),
         "max_depth": _int(-1, 15), "min_child_samples": _int(5, 100), "subsample": _float(0.5, 1.0),
         "colsample_bytree": _float(0.5, 1.0)},
    ),
}


def _spec(name: str) -> ModelSpec:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name]


PARALLELISM = 8


# Until it ends, a fit of trees keeps each of its rows as objects: 90 bytes were measured for one input, and each more adds 4.
# Fits go side by side while these take no more a slot than this; of so many rows there are parts enough for one fit to fill the slots.
TREE_ROW_BYTES, TREE_BYTES_PER_SLOT = 90, 900_000_000


def _at_once(table: DataFrame, names: Sequence[str], rows: int, parallelism: int) -> int:
    """How many fits of these models on so many rows of an assembled table go side by side."""
    if all(n in MODELS and MODELS[n].build is logistic for n in names):  # these keep packed blocks
        return parallelism
    width = table.schema[FEATURES].metadata.get("ml_attr", {}).get("num_attrs", 1)
    held = max(rows, 1) * (TREE_ROW_BYTES + 4 * width)
    return max(1, min(parallelism, TREE_BYTES_PER_SLOT * table.sparkSession.sparkContext.defaultParallelism // held))


def _side_by_side(spark: SparkSession, tasks: Sequence[Callable], parallelism: int, pool: ThreadPoolExecutor | None = None) -> list:
    """Results of driver-side tasks, in order; each starts Spark jobs of its own. A ``pool`` is shared with other callers."""
    if pool is not None:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(parallelism, len(tasks))) as own:
        return _side_by_side(spark, tasks, parallelism, own)


def _cut_lineage(spark: SparkSession) -> None:
    """Boosting cuts the lineage of its margins every ten rounds, but only where a checkpoint folder is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(fresh_path(spark, "rounds"))


# -- fit, score, explain ----------------------------------------------------------

def importance(model: Model, names: Sequence[str], top: int = 15) -> list[tuple[str, float]]:
    """Largest importances by size; a linear model gives its signed coefficients."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = model.coefficients.toArray()
    else:
        return []
    ranked = sorted(zip(names, values), key=lambda nv: (-abs(nv[1]), nv[0]))
    return [(plain_name(n), float(v)) for n, v in ranked[:top]]


def score_models(assembled: DataFrame, models: Mapping[str, Model], keep: Sequence[str]) -> DataFrame:
    """(model, keep, score, pred): one scan scores all models, then each row unfolds."""
    out, cells = assembled, []
    for i, (name, model) in enumerate(models.items()):
        m = model.copy()
        m.setRawPredictionCol(f"__raw{i}").setProbabilityCol(f"__p{i}").setPredictionCol(f"__y{i}")
        out = m.transform(out)
        cells.append(F.struct(
            F.lit(name).alias("model"), vector_to_array(f"__p{i}")[1].alias("score"), F.col(f"__y{i}").cast("int").alias("pred")))
    return out.select(*keep, F.explode(F.array(*cells)).alias("e")).select(*keep, "e.*")


def _status(spark: SparkSession, fitted: Mapping, failures: Mapping[str, str]) -> DataFrame:
    rows = [(n, "trained", None) for n in fitted] + [(n, "failed", why) for n, why in failures.items()]
    return local_table(spark, sorted(rows), "model string, status string, error string")


@dataclass
class Training:
    """Fitted pipelines with metrics per model and split."""

    pipelines: dict[str, PipelineModel]
    classifiers: dict[str, Model]
    names: list[str]
    scored: DataFrame
    metrics: DataFrame
    failures: dict[str, str]
    seconds: dict[str, float]
    table: DataFrame
    split: str = "split"
    label: str = "y"

    def roc(self) -> DataFrame:
        """Points of the ROC curve of each model on each split."""
        return roc_curve(self.scored, self.label, "score", ["model", self.split])

    def leaderboard(self, split: str = "test") -> DataFrame:
        return leaderboard(self.metrics, split)

    def status(self) -> DataFrame:
        """One row per model asked for: trained or failed, and why."""
        return _status(self.table.sparkSession, self.classifiers, self.failures)

    def importance(self, top: int = 15) -> DataFrame:
        spark = self.table.sparkSession
        rows = [(m, i + 1, f, v) for m, c in self.classifiers.items() for i, (f, v) in enumerate(importance(c, self.names, top))]
        return local_table(spark, rows, "model string, rank int, feature string, importance double")

    def release(self) -> None:
        self.scored.unpersist()
        self.table.unpersist()


# A partition of an assembled table holds no more rows, and no fewer while there are idle slots.
ROWS_PER_PART, LEAST_ROWS_PER_PART = 1_000_000, 25_000


def _evenly(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all slots, however few splits or row groups the source has, and in an order of their own values.

    Every round of a fit is a stage over the table's partitions, so one partition would be one busy core. The order
    makes what a seed draws independent of the order in which shuffled blocks arrive.
    """
    rows, slots = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(rows / ROWS_PER_PART), min(slots, math.ceil(rows / LEAST_ROWS_PER_PART)))
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return df.repartition(parts).sortWithinPartitions(*[F.col(_quote(c)) for c in plain])


def assemble(df: DataFrame, label: str, fit_on: DataFrame | Column, keep: Sequence[str], exclude: Sequence[str] = ()):
    """Preprocessor fitted on part of the rows, and the persisted narrow table of all of them.

    ``fit_on`` is a condition on the rows, or rows of their own.
    """
    left_out = [label, *keep, *exclude]
    rows = _evenly(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        part = rows.filter(fit_on) if isinstance(fit_on, Column) else rows if fit_on is df else fit_on
        prep = fit_preprocessor(part, exclude=left_out, out=FEATURES)
        table = prep.transform(rows).select(*dict.fromkeys([*keep, label]), FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        table.count()
    finally:
        rows.unpersist()
    return prep, table


def train(
    df: DataFrame, label: str, split: str = "split", models: Sequence[str] = tuple(MODELS), params: Mapping[str, Mapping] | None = None,
    keep: Sequence[str] = (), exclude: Sequence[str] = (), seed: int = 42, parallelism: int = PARALLELISM,
) -> Training:
    """Fit each model on the train split and score all splits. A model that fails is skipped."""
    _cut_lineage(df.sparkSession)
    keep = list(dict.fromkeys([*keep, split]))
    prep, table = assemble(df, label, F.col(split) == "train", keep, exclude)
    part = table.filter(F.col(split) == "train")
    rows = part.count()
    fitted, failures, seconds = {}, {}, {}

    def task(name):
        def run():
            start = time.monotonic()
            try:
                spec = _spec(name)
                chosen = {**spec.live, **((params or {}).get(name) or {})}
                return name, spec.build(chosen, rows, label, seed).fit(part), time.monotonic() - start
            except Exception as e:  # one bad model must not lose the others
                log.warning("model %s failed: %s", name, e)
                return name, e, 0.0
        return run

    for name, model, took in _side_by_side(df.sparkSession, [task(n) for n in models], _at_once(table, models, rows, parallelism)):
        if isinstance(model, Exception):
            failures[name] = str(model)
        else:
            fitted[name], seconds[name] = model, took
    if not fitted:
        table.unpersist()
        raise RuntimeError(f"no model could be trained: {failures}")
    try:
        # read by every metric and by the caller: rows are scored once
        scored = score_models(table, fitted, [*keep, label]).persist(StorageLevel.MEMORY_AND_DISK)
        metrics = evaluate(scored, label, "score", "pred", ["model", split]).withColumnRenamed(split, "split")
    except Exception:
        table.unpersist()
        raise
    pipelines = {n: PipelineModel([*prep.stages, m]) for n, m in fitted.items()}
    return Training(pipelines, fitted, feature_names(prep), scored, metrics, failures, seconds, table, split, label)


def out_of_fold(
    table: DataFrame, label: str, name: str, params: Mapping, fold: str = "fold", k: int = 5, keep: Sequence[str] = (),
    seed: int = 42, parallelism: int = PARALLELISM, pool: ThreadPoolExecutor | None = None, ledger: Ledger | None = None, rows: int | None = None,
    pred: bool = True,
) -> DataFrame:
    """Score of every row by the model that did not see its fold. A ``ledger`` keeps the scores of each fold.

    Without ``pred`` there is the score alone, which takes the features to the probability in one step.
    """
    spec = _spec(name)
    _cut_lineage(table.sparkSession)
    rows = table.count() if rows is None else rows

    def held(i: int) -> DataFrame:
        model = spec.build(params, rows * (k - 1) // k, label, seed).fit(table.filter(F.col(fold) != i))
        part, columns = table.filter(F.col(fold) == i), dict.fromkeys([*keep, label, fold])
        if not pred:
            model.setRawPredictionCol("").setPredictionCol("")
            return model.transform(part).select(*columns, vector_to_array("probability")[1].alias("score"))
        return with_score(model.transform(part)).select(*columns, "score", "pred")

    def task(i: int) -> Callable:
        return (lambda: held(i)) if ledger is None else lambda: ledger.frame(f"{name}/fold-{i}", lambda: held(i))

    parts = _side_by_side(table.sparkSession, [task(i) for i in range(k)], _at_once(table, [name], rows, parallelism), pool)
    return reduce(DataFrame.unionByName, parts)


def fold_scores(oof: DataFrame, label: str, fold: str = "fold") -> list[float]:
    """AUC per fold, from one grouped evaluation of all folds."""
    rows = evaluate(oof, label, "score", by=[fold]).select(fold, "roc_auc").orderBy(fold).collect()
    return [r["roc_auc"] for r in rows]


def cross_validate(table: DataFrame, label: str, name: str, params: Mapping | None = None, **kw) -> list[float]:
    params = {**_spec(name).defaults, **(params or {})}
    held = out_of_fold(table, label, name, params, pred=False, **kw).persist(StorageLevel.MEMORY_AND_DISK)  # the evaluation reads it more than once
    try:
        return fold_scores(held, label, kw.get("fold", "fold"))
    finally:
        held.unpersist()


def _settings(estimator) -> tuple:
    """What a fit depends on besides its rows."""
    return type(estimator).__name__, str(sorted((p.name, v) for p, v in estimator.extractParamMap().items()))


def cross_validate_models(table: DataFrame, label: str, names: Sequence[str] = tuple(MODELS), parallelism: int = PARALLELISM, **kw) -> DataFrame:
    """(model, keep, label, fold, score, pred): out-of-fold rows of several models, whose fits all share one pool.

    Models whose settings come to the same estimator, seed included, share its fits.
    """
    spark = table.sparkSession
    _cut_lineage(spark)
    kw = {"rows": table.count(), "seed": 42, **kw}
    alike: dict = {}
    for n in names:
        alike.setdefault(_settings(_spec(n).build(_spec(n).defaults, kw["rows"], label, kw["seed"])), []).append(n)
    with ThreadPoolExecutor(_at_once(table, names, kw["rows"], parallelism)) as pool, ThreadPoolExecutor(len(alike)) as models:
        of = lambda n: out_of_fold(table, label, n, _spec(n).defaults, pool=pool, **kw)
        held = [models.submit(inheritable_thread_target(spark)(of), same[0]) for same in alike.values()]
        parts = {n: f.result().withColumn("model", F.lit(n)) for same, f in zip(alike.values(), held) for n in same}
    return reduce(DataFrame.unionByName, [parts[n] for n in names])


# -- search -----------------------------------------------------------------------

def sample_params(space: Mapping, rng: random.Random) -> dict:
    """One draw: int, float, log-scaled float or choice; a conditional one only where it applies."""
    out: dict = {}
    for name, s in space.items():
        if "when" in s and out.get(s["when"][0]) != s["when"][1]:
            continue
        if s["type"] == "int":
            out[name] = rng.randint(s["low"], s["high"])
        elif s["type"] == "categorical":
            out[name] = rng.choice(s["choices"])
        elif s.get("log"):
            out[name] = math.exp(rng.uniform(math.log(s["low"]), math.log(s["high"])))
        else:
            out[name] = rng.uniform(s["low"], s["high"])
    return out


@dataclass
class Search:
    model: str
    best_params: dict
    best_score: float
    best_std: float
    cv_scores: list[float]
    trials: list[tuple[dict, float | None]]

    def table(self, spark) -> DataFrame:
        """One row per trial; a failed one has no score."""
        rows = [(self.model, i, str(sorted(p.items(), key=str)), s, "failed" if s is None else "scored") for i, (p, s) in enumerate(self.trials)]
        return local_table(spark, rows, "model string, trial int, params string, roc_auc double, status string")


def tune(
    table: DataFrame, label: str, name: str, n_trials: int = 50, k: int = 5, fold: str = "fold", patience: int = 10,
    min_gain: float = 0.001, seed: int = 42, space: Mapping | None = None, fixed: Mapping | None = None, parallelism: int = PARALLELISM,
    timeout: float | None = None, pool: ThreadPoolExecutor | None = None, ledger: Ledger | None = None,
) -> Search:
    """Seeded random search by mean fold AUC; stops after ``patience`` trials without real gain.

    Draws depend on the seed alone, so with a ``ledger`` a search that is started again draws the same trials and
    takes the scores of those that it has.
    """
    spec = _spec(name)
    rng = random.Random(seed)
    trials, best, idle, mark, start = [], None, 0, float("-inf"), time.monotonic()
    for i in range(n_trials):
        drawn = sample_params(spec.space if space is None else space, rng)
        chosen = {**spec.defaults, **drawn, **(fixed or {})}
        try:
            def scored(chosen=chosen):
                return {"params": chosen, "scores": cross_validate(
                    table, label, name, chosen, fold=fold, k=k, seed=seed, parallelism=parallelism, pool=pool)}

            scores = (scored() if ledger is None else ledger.row(f"{name}/trial-{i}", scored))["scores"]
            mean = sum(scores) / len(scores)
        except Exception as e:
            log.warning("trial %s failed: %s", drawn, e)
            trials.append((chosen, None))
            continue
        trials.append((chosen, mean))
        if best is None or mean > best[1]:
            best = (chosen, mean, scores)
        if mean > mark + min_gain:
            mark, idle = mean, 0
        else:
            idle += 1
        if idle >= patience or (timeout and time.monotonic() - start > timeout):
            break
    if best is None:
        raise RuntimeError(f"no trial of {name} succeeded")
    params, mean, scores = best
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return Search(name, params, mean, spread, scores, trials)


class Searches(dict):
    """Searches by model; ``failures`` says why the others gave none."""

    failures: dict[str, str]

    def status(self, spark: SparkSession) -> DataFrame:
        """One row per model asked for: searched or failed, and why."""
        rows = [(n, "searched", s.best_score, None) for n, s in self.items()] + [(n, "failed", None, why) for n, why in self.failures.items()]
        return local_table(spark, sorted(rows), "model string, status string, best_score double, error string")


def tune_multiple(table: DataFrame, label: str, names: Sequence[str], **kw) -> Searches:
    """A search per model; one that fails is a row of ``status``."""
    out = Searches()
    out.failures = {}
    for name in names:
        try:
            out[name] = tune(table, label, name, **kw)
        except Exception as e:
            log.warning("search for %s failed: %s", name, e)
            out.failures[name] = str(e)
    return out


def quick_tune(table: DataFrame, label: str, name: str, n_trials: int = 20, k: int = 3, **kw) -> Search:
    return tune(table, label, name, n_trials=n_trials, k=k, **kw)


# -- configured runs --------------------------------------------------------------

@dataclass
class RunConfig:
    models: Sequence[str] = ("LightGBM", "XGBoost", "LogisticRegression")
    k: int = 5
    tuning: bool = True
    trials: int = 50
    seed: int = 42
    oof: bool = True
    params: Mapping[str, Mapping] = field(default_factory=dict)
    spaces: Mapping[str, Mapping] = field(default_factory=dict)
    artifact_dir: str | None = None
    parallelism: int = PARALLELISM


@dataclass
class Run:
    experiment_id: str
    pipelines: dict[str, PipelineModel]
    leaderboard: DataFrame
    oof: DataFrame | None
    test_metrics: DataFrame | None
    path: str | None
    failures: dict[str, str]
    table: DataFrame
    other_metrics: DataFrame | None = None
    ledger: Ledger | None = None

    def status(self) -> DataFrame:
        """One row per model asked for: trained or failed, and why."""
        return _status(self.table.sparkSession, self.pipelines, self.failures)

    def release(self) -> None:
        self.table.unpersist()


TEST_COLUMNS = {"roc_auc": "test_auc", "ks_statistic": "test_ks", "gini": "test_gini",
                "precision": "test_precision", "recall": "test_recall", "f1": "test_f1"}


def _metrics(scored: DataFrame, label: str) -> DataFrame:
    """The metrics of each model, written out, of rows that are scored once."""
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return settle(evaluate(scored, label, "score", "pred", ["model"]), "metrics")
    finally:
        scored.unpersist()


def run_experiment(
    train_df: DataFrame, label: str, keys: Sequence[str], config: RunConfig | None = None, test_df: DataFrame | None = None,
    exclude: Sequence[str] = (), others: Mapping[str, DataFrame] | None = None, experiment_id: str | None = None,
) -> Run:
    """Search or cross-validate, fit on all training rows, score the test rows, rank, save.

    ``others`` are further rows by name, such as oot and etrc, whose metrics are ``other_metrics``.

    Each trial's scores, each fold's out-of-fold rows and each final model are entries of a ledger below
    ``artifact_dir`` (without it, below the shared folder) as soon as they are there. A run given the
    ``experiment_id`` of one that was killed, with the same rows and settings, fits only what that one had not.
    Models run side by side; all their fits share one pool of ``parallelism`` threads, or fewer where trees are fitted on many rows.
    """
    config = config or RunConfig()
    spark = train_df.sparkSession
    _cut_lineage(spark)
    experiment = experiment_id or uuid.uuid4().hex[:8]
    ledger = Ledger(spark, f"{(config.artifact_dir or shared_dir(spark) + '/experiments').rstrip('/')}/{experiment}")
    folded = stratified_folds(train_df, label, keys, config.k, config.seed)
    keep = [*keys, "fold"]
    prep, table = assemble(folded, label, folded, keep, exclude)
    rows = table.count()
    names = feature_names(prep)
    ledger.same({"rows": rows, "names": names, "label": label, "k": config.k, "seed": config.seed, "tuning": config.tuning,
                 "trials": config.trials, "params": {m: dict(p) for m, p in config.params.items()}, "spaces": {m: dict(p) for m, p in config.spaces.items()}})
    fitted, meta, folds, failures, oof = {}, [], [], {}, None

    def whole(name: str, pool: ThreadPoolExecutor):
        start = time.monotonic()
        spec = _spec(name)
        fixed = config.params.get(name, {})
        if config.tuning:
            params = tune(table, label, name, config.trials, config.k, seed=config.seed, fixed=fixed, space=config.spaces.get(name),
                          pool=pool, ledger=ledger).best_params
        else:
            params = {**spec.defaults, **fixed}
        fit = lambda: ledger.model(f"{name}/final", lambda: spec.build(params, rows, label, config.seed).fit(table))
        final = pool.submit(inheritable_thread_target(spark)(fit))
        held = out_of_fold(table, label, name, params, k=config.k, keep=keys, seed=config.seed, pool=pool, ledger=ledger, rows=rows)
        took = ledger.row(f"{name}/time", lambda: {"seconds": time.monotonic() - start, "at": datetime.now(timezone.utc).isoformat()})
        return params, held, fold_scores(held, label), final.result(), took

    with ThreadPoolExecutor(_at_once(table, config.models, rows, config.parallelism)) as pool, ThreadPoolExecutor(max(1, len(config.models))) as side:
        running = {name: side.submit(inheritable_thread_target(spark)(whole), name, pool) for name in config.models}
        for name, future in running.items():
            try:
                params, held, scores, fitted[name], took = future.result()
            except Exception as e:  # one bad model must not lose the others
                log.warning("model %s failed: %s", name, e)
                failures[name] = str(e)
                continue
            if config.oof:
                part = held.withColumn("model", F.lit(name))
                oof = part if oof is None else oof.unionByName(part)
            folds += [(name, i, s) for i, s in enumerate(scores)]
            meta.append({"model": name, "model_id": f"{experiment}_{name}", "params": params, "feature_names": names,
                         "trained_at": datetime.fromisoformat(took["at"]), "duration_s": took["seconds"], "cv_scores": scores})
    if not fitted:
        table.unpersist()
        raise RuntimeError(f"no model could be trained: {failures}")
    test_metrics, extra = None, {}
    if test_df is not None:
        test_metrics = _metrics(score_models(prep.transform(test_df), fitted, [label]), label)
        extra = {r["model"]: {t: r[s] for s, t in TEST_COLUMNS.items()} for r in test_metrics.collect()}
        for m in meta:
            m["test_metrics"] = extra.get(m["model"])
    other_metrics = None
    for name, rows_of in (others or {}).items():
        part = _metrics(score_models(prep.transform(rows_of), fitted, [label]), label).withColumn("split", F.lit(name))
        other_metrics = part if other_metrics is None else other_metrics.unionByName(part)
    columns = list(TEST_COLUMNS.values())
    facts = local_table(
        spark, [(m["model"], m["model_id"], m["duration_s"], *[extra.get(m["model"], {}).get(c) for c in columns]) for m in meta],
        "model string, model_id string, training_time_s double, " + ", ".join(f"{c} double" for c in columns))
    board = cv_leaderboard(local_table(spark, folds, "model string, fold int, roc_auc double"), facts)
    pipelines = {n: PipelineModel([*prep.stages, m]) for n, m in fitted.items()}
    path = save_experiment(spark, config.artifact_dir, experiment, pipelines, meta) if config.artifact_dir else None
    return Run(experiment, pipelines, board, oof, test_metrics, path, failures, table, other_metrics, ledger)
