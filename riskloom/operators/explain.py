"""Shapley explanations as columns: exact for linear models, model-agnostic for any other.

The result of both is one row per explained row, with an array of
``(feature, value, contribution)``; top lists are read off that array without a shuffle.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.hashcuts import row_hash
from ..session import fresh_path, remove
from .boosting import entries
from .models import FEATURES, Training
from .preprocess import slot_groups

BACKGROUND_ROWS = 100
PERMUTATION, EXACT = "permutation", "exact"


def background(df: DataFrame, features: Sequence[str], keys: Sequence[str], n: int = BACKGROUND_ROWS, seed: int = 42) -> list[list[float]]:
    """A reproducible sample of at most ``n`` rows: those of the smallest hashes (a distributed top-k)."""
    rows = df.select(row_hash(keys, seed).alias("__h"), *[F.col(f).cast("double").alias(f) for f in features])
    return [list(r)[1:] for r in rows.orderBy("__h").limit(n).collect()]


def means(rows: Sequence[Sequence[float]]) -> list[float]:
    return [math.fsum(c) / len(c) for c in zip(*rows)]


def _cells(features, values: Sequence[Column], parts: Sequence[Column]) -> Column:
    return F.array(*[
        F.struct(F.lit(f).alias("feature"), v.cast("double").alias("value"), c.alias("contribution"))
        for f, v, c in zip(features, values, parts)
    ])


def linear(df: DataFrame, id: Sequence[str], coefficients: Mapping[str, float], intercept: float, centre: Sequence[float]) -> DataFrame:
    """``coef * (x - background mean)``; base and prediction are on the log-odds scale."""
    features = list(coefficients)
    base = intercept + math.fsum(c * m for c, m in zip(coefficients.values(), centre))
    parts = [(F.col(f).cast("double") - F.lit(float(m))) * F.lit(float(coefficients[f])) for f, m in zip(features, centre)]
    prediction = F.lit(base)
    for p in parts:
        prediction = prediction + p
    return df.select(
        *id, prediction.alias("prediction"), F.lit(base).alias("base_value"),
        _cells(features, [F.col(f) for f in features], parts).alias("contributions"))


def coalition_weights(d: int, n_permutations: int, seed: int, method: str = PERMUTATION) -> dict[tuple[bool, ...], list[float]]:
    """For each set of features taken from the row, the weight of its score in each contribution.

    ``permutation``: the sets met along sampled permutations and their reverses, whose weights add
    up per set; at most ``n_permutations`` (d + 1) sets. ``exact``: all 2^d sets with Shapley weights.
    """
    if method not in (PERMUTATION, EXACT):
        raise ValueError(f"unknown method {method!r}")
    out: dict[tuple[bool, ...], list[float]] = {}
    if method == EXACT:
        for mask in itertools.product((False, True), repeat=d):
            s = sum(mask)
            out[mask] = [
                1 / (d * math.comb(d - 1, s - 1)) if inside else -1 / (d * math.comb(d - 1, s))
                for inside in mask
            ]
        return out
    rng = random.Random(seed)
    walks = []
    for _ in range(max(1, n_permutations // 2)):
        p = list(range(d))
        rng.shuffle(p)
        walks += [p, p[::-1]]
    for p in walks:
        mask = [False] * d
        for j in p:
            out.setdefault(tuple(mask), [0.0] * d)[j] -= 1 / len(walks)
            mask[j] = True
            out.setdefault(tuple(mask), [0.0] * d)[j] += 1 / len(walks)
    return out


def agnostic(
    df: DataFrame, id: Sequence[str], features: Sequence[str], score: Callable[[DataFrame], DataFrame],
    rows: Sequence[Sequence[float]], n_permutations: int = 16, seed: int = 42, method: str = PERMUTATION,
) -> DataFrame:
    """Shapley contributions of any model; the column ``method`` says how they were found.

    A row unfolds into sets x background rows: 16 walks over d features give at most 16 (d + 1) sets,
    the exact sum 2^d. The number of features never chooses between them.

    ``score`` receives rows with the feature columns and adds a ``score`` column, for
    instance through a pipeline's ``transform``. Each row unfolds in place into its
    mixtures with the background (a literal of at most a hundred rows), so the final
    aggregate combines within the task and shuffles one partial row per explained row.
    """
    features = list(features)
    d = len(features)
    weights = coalition_weights(d, n_permutations, seed, method)
    masks = F.array(*[
        F.struct(F.array(*[F.lit(b) for b in m]).alias("take"), F.array(*[F.lit(float(x)) for x in w]).alias("w"),
                 F.lit(not any(m)).alias("none"), F.lit(all(m)).alias("all"))
        for m, w in weights.items()
    ])
    pool = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    kept = df.select(*id, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    mixed = kept.withColumn("__m", F.explode(masks)).withColumn("__b", F.explode(pool)).select(
        *id, *[f"__x{i}" for i in range(d)], "__m",
        *[F.when(F.col("__m.take")[i], F.col(f"__x{i}")).otherwise(F.col("__b")[i]).alias(f) for i, f in enumerate(features)])
    n = float(len(rows))
    s = F.col("score")
    summed = score(mixed).groupBy(*id).agg(
        *[F.first(f"__x{i}").alias(f"__x{i}") for i in range(d)],
        *[(F.sum(s * F.col("__m.w")[i]) / n).alias(f"__c{i}") for i in range(d)],
        F.avg(F.when(F.col("__m.none"), s)).alias("base_value"),
        F.avg(F.when(F.col("__m.all"), s)).alias("prediction"),
    )
    return summed.select(
        *id, "prediction", "base_value",
        _cells(features, [F.col(f"__x{i}") for i in range(d)], [F.col(f"__c{i}") for i in range(d)]).alias("contributions"), F.lit(method).alias("method"))


# -- models that are sums ---------------------------------------------------------
# A mixture of a row and a background row ends in a leaf if each column on the leaf's path, taken from either, passes its tests there. So the mean
# over the background is a product, and what a leaf adds to a row's contributions follows from which columns of the row pass: no mixture is built.

# Cells of the matrix that a task holds at a time.
CELLS_AT_ONCE = 4_000_000


def _trees(spark: SparkSession, model: Model, forest: bool) -> list[dict]:
    """Each tree's nodes by id, as MLlib saves them: (value of a leaf, or feature, threshold or left categories, left, right)."""
    path = fresh_path(spark, "explained-model")
    try:
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    finally:
        remove(spark, path)
    trees: list[dict] = [{} for _ in range(model.getNumTrees)]
    for r in rows:
        if r["leftChild"] < 0:
            stats = r["impurityStats"]
            value = stats[1] / sum(stats) if forest else model.treeWeights[r["treeID"]] * r["prediction"]
            trees[r["treeID"]][r["id"]] = (value,)
        else:
            cut = r["split"]["leftCategoriesOrThreshold"]
            trees[r["treeID"]][r["id"]] = (r["split"]["featureIndex"], cut[0] if r["split"]["numCategories"] < 0 else list(cut), r["leftChild"], r["rightChild"])
    return trees


def _sums_of_trees(trees: list[dict], player: Sequence[int], takes: np.ndarray, weights: np.ndarray, base: np.ndarray) -> Callable:
    """Of each row the scores of all sets, times ``weights`` (sets x results); a set's score is the mean over the rows of ``base``."""
    def of(x: np.ndarray) -> np.ndarray:
        n, both = len(x), np.concatenate([x, base])
        out = np.zeros((n, weights.shape[1]))

        def leaf(value: float, passed: dict[int, np.ndarray]) -> None:
            bits = 1 << np.arange(len(passed))
            pattern = np.zeros(len(both), np.int64)
            for bit, ok in zip(bits, passed.values()):
                pattern += bit * ok
            taken = takes[:, list(passed)] @ bits
            rest = bits.sum() - taken
            share = ((pattern[n:] & rest[:, None]) == rest[:, None]).mean(axis=1)
            seen, at = (np.arange(1 << len(bits)), pattern[:n]) if 1 << len(bits) <= n else np.unique(pattern[:n], return_inverse=True)
            adds = np.zeros((len(seen), weights.shape[1]))
            for t, q, w in zip(taken, share, weights):  # one by one: so a row's sums don't depend on the rows beside it
                adds += ((seen & t) == t)[:, None] * (value * q * w)
            out[:] += adds[at]

        def walk(tree: dict, node: int, passed: dict[int, np.ndarray]) -> None:
            if len(tree[node]) == 1:
                return leaf(tree[node][0], passed)
            feature, cut, left, right = tree[node]
            goes = np.isin(both[:, feature], cut) if isinstance(cut, list) else both[:, feature] <= cut
            g = player[feature]
            before = passed.get(g, True)
            walk(tree, left, {**passed, g: goes & before})
            walk(tree, right, {**passed, g: ~goes & before})

        for tree in trees:
            walk(tree, 0, {})
        return out

    return of


def _sums_of_slots(coef: np.ndarray, intercept: float, player: Sequence[int], takes: np.ndarray, weights: np.ndarray, base: np.ndarray) -> Callable:
    """The same for a linear margin: a set's score adds up what its columns give and what the others give in the mean of ``base``."""
    def given(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), takes.shape[1]))
        for slot, (g, c) in enumerate(zip(player, coef)):
            out[:, g] += c * x[:, slot]
        return out

    mean, gain = given(base).mean(axis=0), takes.T.astype(float) @ weights
    fixed = intercept * weights.sum(axis=0) + mean @ ((~takes).T.astype(float) @ weights)

    def of(x: np.ndarray) -> np.ndarray:
        out = np.tile(fixed, (len(x), 1))
        for own, g in zip(given(x).T, gain):
            out += own[:, None] * g
        return out

    return of


def _additive(spark: SparkSession, model: Model, output: str, player: Sequence[int], masks: Sequence[Mapping], base: Sequence[Sequence[float]]) -> Callable | None:
    """Contributions, base and prediction of rows of slots, if what is explained is a sum over leaves or slots; None if not."""
    kind = type(model).__name__
    takes = np.array([m["take"] for m in masks], bool)
    ends = np.array([[m["none"], m["all"]] for m in masks], float)
    weights, rows = np.c_[np.array([m["w"] for m in masks]), ends], np.array(base)
    if kind == "RandomForestClassificationModel":  # a probability is the mean of the trees' shares
        weights = weights / (model.getNumTrees if output == "probability" else 1)
        return _sums_of_trees(_trees(spark, model, True), player, takes, weights, rows)
    if output == "margin" and kind == "GBTClassificationModel":
        return _sums_of_trees(_trees(spark, model, False), player, takes, weights, rows)
    if output == "margin" and kind == "LogisticRegressionModel":
        return _sums_of_slots(model.coefficients.toArray(), float(model.intercept), player, takes, weights, rows)
    return None


def explain_model(
    training: Training, name: str, id: Sequence[str], rows: DataFrame | None = None, n_background: int = BACKGROUND_ROWS,
    n_permutations: int = 16, seed: int = 42, method: str = PERMUTATION, output: str = "probability", background_split: str = "train",
    chunks: int = 1,
) -> DataFrame:
    """Shapley contributions of each source column to what a fitted model says of a row; as from ``agnostic``.

    A player is a source column: all slots that it has in the assembled vector, a number's one or a category's
    many, come from the row or from a background row together. ``rows`` are assembled rows, of the training's own
    table if not given; the background are at most ``n_background`` of its ``background_split`` rows. ``value`` is the standardised number, or for a
    category the place of its level among the column's slots, null if it has none. ``output`` is "probability" or "margin",
    the raw prediction, which for a logistic model is its log-odds.

    One row unfolds into sets x background vectors, which the model scores: n_permutations (d + 1) sets at most for d
    columns, see ``coalition_weights``. So many scores a row are dealt over all slots by ``id``, however few partitions hold the rows,
    then built, scored and summed within the task. Where what is explained is a sum over leaves or slots, as margins and the probability of a forest
    are, the same means come from these sums, without a vector per set and background row. ``chunks`` explains so many hash parts of the rows one after the other, each written before the next.
    """
    if name not in training.classifiers:
        raise ValueError(f"no fitted model {name!r}; fitted: {sorted(training.classifiers)}")
    if output not in ("probability", "margin"):
        raise ValueError(f"unknown output {output!r}")
    model = training.classifiers[name].copy()
    groups = slot_groups(training.pipelines[name])
    d = len(groups)
    player = [g for g, (_, slots) in enumerate(groups) for _ in slots]
    weights = coalition_weights(d, n_permutations, seed, method)
    spark = training.table.sparkSession
    x = vector_to_array(FEATURES)
    pool = training.table.filter(F.col(training.split) == background_split).select(row_hash(id, seed).alias("h"), x.alias("x")).orderBy("h").limit(n_background)
    base = [list(r["x"]) for r in pool.select("x").collect()]
    masks = [{"take": list(m), "w": w, "none": not any(m), "all": all(m)} for m, w in weights.items()]
    # one literal each, however many slots there are
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    source = literal(player, "array<int>")
    all_masks = literal(masks, "array<struct<take: array<boolean>, w: array<double>, none: boolean, all: boolean>>")
    all_base = literal(base, "array<array<double>>")
    score = vector_to_array("probability" if output == "probability" else "rawPrediction")[1]

    def value(x: Column, at: int, width: int, numeric: bool) -> Column:
        if numeric:
            return x[at]
        place = F.array_position(F.slice(x, at + 1, width), F.lit(1.0))
        return F.when(place > 0, place.cast("double") - 1)

    parts = max(4 * spark.sparkContext.defaultParallelism, training.table.rdd.getNumPartitions())

    sums = _additive(spark, model, output, player, masks, base)

    def added(part: DataFrame) -> DataFrame:
        kept = part.repartition(parts, *id).select(F.col(FEATURES).alias("__v"), F.lit(0.0).alias("__y"), *id)
        ids = T.StructType([f for f in kept.schema if f.name in id])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS_AT_ONCE // len(player))
            for big in batches:
                for a in range(0, big.num_rows, step):
                    batch = big.slice(a, step)
                    _, row, feature, v = entries([batch])
                    dense = np.zeros((batch.num_rows, len(player)))
                    dense[row, feature] = v
                    found, values, first = sums(dense), [], 0
                    for _, slots in groups:
                        own = dense[:, first:first + len(slots)]
                        place = (own == 1).argmax(axis=1)
                        values.append(own[:, 0] if slots[0].startswith("num__") else np.where((own == 1).any(axis=1), place, np.nan))
                        first += len(slots)
                    columns = [pa.array(c, from_pandas=not groups[i][1][0].startswith("num__")) for i, c in enumerate(values)]
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(f.name) for f in ids], *columns, *[pa.array(c) for c in found.T.copy()]],
                        [*ids.names, *[f"__v{i}" for i in range(d)], *[f"__c{i}" for i in range(d)], "base_value", "prediction"])

        numbers = [T.StructField(c, T.DoubleType()) for c in [f"__v{i}" for i in range(d)] + [f"__c{i}" for i in range(d)] + ["base_value", "prediction"]]
        out = kept.mapInArrow(run, T.StructType([*ids, *numbers]))
        return out.select(
            *id, "prediction", "base_value", _cells([c for c, _ in groups], [F.col(f"__v{i}") for i in range(d)], [F.col(f"__c{i}") for i in range(d)]).alias("contributions"),
            F.lit(method).alias("method"))

    def of(part: DataFrame) -> DataFrame:
        if sums is not None:
            return added(part)
        kept = part.repartition(parts, *id).select(*id, x.alias("__x"))
        mixed = kept.withColumn("__m", F.explode(all_masks)).withColumn("__b", F.explode(all_base)).withColumn("__p", source).withColumn(
            FEATURES, array_to_vector(F.transform("__x", lambda v, i: F.when(F.col("__m.take")[F.col("__p")[i]], v).otherwise(F.col("__b")[i]))))
        scored = model.transform(mixed.drop("__b", "__p")).withColumn("__s", score)
        s = F.col("__s")
        summed = scored.groupBy(*id).agg(
            F.first("__x").alias("__x"), *[(F.sum(s * F.col("__m.w")[i]) / len(base)).alias(f"__c{i}") for i in range(d)],
            F.avg(F.when(F.col("__m.none"), s)).alias("base_value"), F.avg(F.when(F.col("__m.all"), s)).alias("prediction"))
        at, values = 0, []
        for _, slots in groups:
            values.append(value(F.col("__x"), at, len(slots), slots[0].startswith("num__")))
            at += len(slots)
        return summed.select(
            *id, "prediction", "base_value", _cells([c for c, _ in groups], values, [F.col(f"__c{i}") for i in range(d)]).alias("contributions"),
            F.lit(method).alias("method"))

    table = training.table if rows is None else rows
    if chunks <= 1:
        return of(table)
    path = fresh_path(spark, "explained")
    for i in range(chunks):
        of(table.filter(F.pmod(F.xxhash64(*id), F.lit(chunks)) == i)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def unfold(explained: DataFrame, id: Sequence[str]) -> DataFrame:
    """(id, feature, value, contribution), one row per feature."""
    return explained.select(*id, F.explode("contributions").alias("e")).select(*id, "e.*")


def global_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, ranked; counts every row given."""
    parts = explained.select(F.explode("contributions").alias("e"))
    sized = parts.groupBy(F.col("e.feature").alias("feature")).agg(F.avg(F.abs("e.contribution")).alias("mean_abs_shap"))
    # one row per feature from here on
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), "feature"))
    return sized.select(rank.alias("rank"), "feature", "mean_abs_shap").orderBy("rank")


def importance_table(explained: DataFrame, top_n: int = 20) -> DataFrame:
    return global_importance(explained).filter(F.col("rank") <= top_n)


def top_contributors(explained: DataFrame, id: Sequence[str], top_n: int = 10) -> DataFrame:
    """Largest positive and negative contributions of every row."""
    def side(keep, sign):
        chosen = F.filter("contributions", keep)
        keyed = F.transform(chosen, lambda e: F.struct(
            (e["contribution"] * sign).alias("k"), e["feature"].alias("feature"), e["contribution"].alias("contribution")))
        first = F.slice(F.array_sort(keyed), 1, top_n)
        return F.transform(first, lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution")))

    return explained.select(
        *id, "prediction", "base_value",
        side(lambda e: e["contribution"] > 0, -1).alias("top_positive"),
        side(lambda e: e["contribution"] < 0, 1).alias("top_negative"))


def summary_data(explained: DataFrame, id: Sequence[str], max_display: int = 20) -> DataFrame:
    """Every row's contributions of the leading features, with the feature's rank."""
    top = importance_table(explained, max_display)
    return unfold(explained, id).join(F.broadcast(top), "feature").select(*id, "rank", "feature", "value", "contribution", "mean_abs_shap")


def dependence_data(explained: DataFrame, id: Sequence[str], feature: str, known: Sequence[str], interaction: str | None = None) -> DataFrame:
    """Value against contribution of one feature, optionally with the value of a second."""
    for f in (feature, interaction):
        if f is not None and f not in known:
            raise ValueError(f"feature {f!r} not found")

    def of(name):
        return F.element_at(F.filter("contributions", lambda e: e["feature"] == name), 1)

    out = explained.select(*id, of(feature).alias("a"), *([of(interaction).alias("b")] if interaction else []))
    cols = [F.col("a.value").alias("feature_value"), F.col("a.contribution").alias("contribution")]
    if interaction:
        cols.append(F.col("b.value").alias("interaction_value"))
    return out.select(*id, *cols)
