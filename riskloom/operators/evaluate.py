"""Scorecard evaluation over any number of models and splits at once.

Every rank measure starts from one aggregate by ``(group, score)``; running totals over the
distinct scores come from ``plans.ordered``, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import decay_alert, traffic_light
from ..plans.ordered import BUCKET, ROWS_PER_BUCKET, SUB, before_buckets, bucket_totals, plan_order, row_numbers, running_totals
from ..plans.rows import join_null_safe

# Fixed value: machine epsilon of a double, to which probabilities are clipped.
EPS = 2.220446049250313e-16
LOWER_IS_BETTER = ("log_loss", "brier_score")
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "gini", "ks_statistic", "log_loss", "brier_score"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group, in one pass; a null prediction counts as an error of its caller and fails."""
    df = checked(df, label, pred)
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
    )


def threshold_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return confusion(df, label, pred, by).withColumns(threshold_columns()).select(*by, *threshold_columns())


def checked(df: DataFrame, label: str, score: str | None = None) -> DataFrame:
    """The same rows; reading one whose score is null or NaN, or whose label is not 0 or 1, is an error."""
    bad = ~F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))
    out = {label: F.when(bad, F.raise_error(F.lit(f"labels in {label!r} must be 0 or 1")).cast(df.schema[label].dataType)).otherwise(F.col(label))}
    if score is not None:
        lost = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
        out[score] = F.when(lost, F.raise_error(F.lit(f"scores in {score!r} must not be null; see unscored()")).cast(df.schema[score].dataType)).otherwise(F.col(score))
    return df.withColumns(out)


def scored_only(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that metrics can use, and per group how many were left out, see ``unscored``."""
    lost = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    usable = ~lost & F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))
    return df.filter(usable), unscored(df, label, score, by)


def unscored(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group, and how many of them no metric can use: null or NaN scores, labels other than 0 and 1."""
    lost = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("n_unscored"),
        F.count_if(~F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))).alias("n_bad_labels"))


def _score_groups(df, label, score, by, pred=None, rows_per_bucket=ROWS_PER_BUCKET):
    """Distinct scores per group with class counts, and the order they are read in."""
    df = checked(df, label, score)
    y = F.col(label) == 1
    totals = {"__p": F.count_if(y), "__q": F.count_if(F.col(label) == 0)}
    order = plan_order(df, by, score, totals, rows_per_bucket=rows_per_bucket, by_value=True)
    p = F.col(pred) == 1 if pred else F.col(score) >= 0.5
    groups = df.groupBy(*by, score).agg(
        F.count_if(y).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
    )
    return groups, order


def evaluate(
    df: DataFrame, label: str, score: str, pred: str | None = None, by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """All metrics of each group. Without ``pred`` a score of 0.5 and above predicts 1."""
    by = list(by)
    groups, order = _score_groups(df, label, score, by, pred, rows_per_bucket)
    cum = order.with_totals(bucket_totals(groups, order, ["pos", "neg"]))
    pos, neg = F.col("pos"), F.col("neg")
    clipped = F.greatest(F.least(F.col(score), F.lit(1 - EPS)), F.lit(EPS))
    below = (F.col("cum_neg") - neg).cast("double") + neg / 2.0
    # what lies before a bucket moves the gap of all its rows alike, so the largest is at one of its two extremes
    point, ahead = F.struct("cum_pos", "cum_neg"), F.col("cum_pos").cast("double") * F.col("__q") - F.col("cum_neg").cast("double") * F.col("__p")
    parts = before_buckets(cum.groupBy(*by, BUCKET, SUB).agg(
        F.sum(pos).alias("P"), F.sum(neg).alias("N"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.sum(pos * below).alias("wins"),
        F.max_by(point, ahead).alias("high"), F.min_by(point, ahead).alias("low"),
        F.first("__p").alias("__p"), F.first("__q").alias("__q"),
        F.sum(-(pos * F.log(clipped) + neg * F.log(1 - clipped))).alias("ll"),
        F.sum(pos * F.pow(1 - F.col(score), 2) + neg * F.pow(score, 2)).alias("br"),
    ), order, ["P", "N"])

    def gap(at):
        cum_pos, cum_neg = F.col("before_P") + F.col(at)["cum_pos"], F.col("before_N") + F.col(at)["cum_neg"]
        return F.abs(F.try_divide(cum_pos, F.col("__p")) - F.try_divide(cum_neg, F.col("__q")))

    agg = parts.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("P", "N", "tp", "fp", "ll", "br")],
        F.sum(F.col("wins") + F.col("P").cast("double") * F.col("before_N")).alias("wins"),
        (F.max(F.greatest(gap("high"), gap("low"))) * 100).alias("ks_statistic"),
    )
    P, N = F.col("P"), F.col("N")
    auc = F.try_divide(F.col("wins"), P.cast("double") * N)
    out = agg.withColumns({"fn": P - F.col("tp"), "tn": N - F.col("fp")})
    out = out.withColumns({
        **threshold_columns(),
        "roc_auc": auc, "gini": 2 * auc - 1,
        "log_loss": F.try_divide(F.col("ll"), P + N), "brier_score": F.try_divide(F.col("br"), P + N),
        "confusion": F.array(F.array("tn", "fp"), F.array("fn", "tp")),
    })
    return out.select(*by, *METRICS, "tn", "fp", "fn", "tp", "confusion")


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), **kw) -> DataFrame:
    return evaluate(df, label, score, by=by, **kw).select(*by, "roc_auc")


def ks_statistic(df: DataFrame, label: str, score: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Largest gap between the class distributions, on a scale of 0 to 100."""
    return evaluate(df, label, score, by=by, **kw).select(*by, "ks_statistic")


def light_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.select(*by, "accuracy", "precision", "recall", "f1", "roc_auc")


def roc_curve(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), keep_all: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(threshold, fpr, tpr) from (0, 0) on. Points on a straight run are dropped.

    A point is on a straight run when the next step adds the same class counts.
    """
    by = list(by)
    groups, order = _score_groups(df, label, score, by, rows_per_bucket=rows_per_bucket)
    cum = running_totals(groups, order, ["pos", "neg"], descending=True, following=["pos", "neg"])
    cum = order.with_totals(cum)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    point = F.struct(
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("__q")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("__p")).alias("tpr"),
    )
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    kept = cum if keep_all else cum.filter(first | last | bends)
    points = F.when(first, F.array(origin, point)).otherwise(F.array(point))
    return kept.select(*by, F.explode(points).alias("e")).select(*by, "e.threshold", "e.fpr", "e.tpr")


def ks_curve(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(threshold, pos_cdf, neg_cdf, ks) at every distinct score."""
    by = list(by)
    groups, order = _score_groups(df, label, score, by, rows_per_bucket=rows_per_bucket)
    cum = order.with_totals(running_totals(groups, order, ["pos", "neg"]))
    pos = F.try_divide(F.col("cum_pos"), F.col("__p"))
    neg = F.try_divide(F.col("cum_neg"), F.col("__q"))
    return cum.select(*by, F.col(score).alias("threshold"), pos.alias("pos_cdf"), neg.alias("neg_cdf"), F.abs(pos - neg).alias("ks"))


def classification_report(confusions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg per group, from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def side(hit, wrong, missed):
        return _ratio(hit, hit + wrong), _ratio(hit, hit + missed), _ratio(2 * hit, 2 * hit + wrong + missed), hit + missed

    one, zero = side(tp, fp, fn), side(tn, fn, fp)
    accuracy = _ratio(tp + tn, n)
    macro = [(a + b) / 2 for a, b in zip(one[:3], zero[:3])]
    weighted = [_ratio(a * one[3] + b * zero[3], n) for a, b in zip(one[:3], zero[:3])]

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))

    rows = F.array(
        row("0", *zero), row("1", *one), row("accuracy", accuracy, accuracy, accuracy, n),
        row("macro avg", *macro, n), row("weighted avg", *weighted, n),
    )
    return confusions.select(*by, F.explode(rows).alias("e")).select(*by, "e.*")


def lift(
    df: DataFrame, label: str, score: str, id: str, by: Sequence[str] = (), n_bins: int = 10,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Lift and cumulative lift per bin of equal size; ties go in the order of ``id``.

    The last bin takes the remainder. A bin without rows has null lift.
    """
    by = list(by)
    df = checked(df, label, score)
    order = plan_order(df, by, score, {"__p": F.count_if(F.col(label) == 1)}, tiebreak=id, rows_per_bucket=rows_per_bucket)
    ranked = order.with_totals(row_numbers(df.select(*by, score, id, label), order, "__rn", descending=True))
    size = F.expr(f"__n div {n_bins}")
    place = F.when(size == 0, n_bins - 1).otherwise(F.least(F.expr(f"(__rn - 1) div greatest(__n div {n_bins}, 1)"), F.lit(n_bins - 1)))
    ranked = ranked.withColumn("__b", place)
    hit = F.col(label) == 1
    arrays = ranked.groupBy(*by).agg(
        F.array(*[F.count_if(F.col("__b") == i) for i in range(n_bins)]).alias("n"),
        F.array(*[F.count_if((F.col("__b") == i) & hit) for i in range(n_bins)]).alias("p"),
    )

    def upto(name, i):
        return F.aggregate(F.slice(name, 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x)

    rate = upto("p", n_bins) / upto("n", n_bins)
    rows = F.transform(F.sequence(F.lit(1), F.lit(n_bins)), lambda i: F.struct(
        i.alias("decile"),
        F.element_at("n", i).alias("n"), F.element_at("p", i).alias("p"),
        upto("n", i).alias("cn"), upto("p", i).alias("cp")))
    out = arrays.select(*by, rate.alias("overall_rate"), F.explode(rows).alias("e")).select(*by, "overall_rate", "e.*")

    def relative(p, n):
        return F.when(F.col(n) > 0, F.when(F.col("overall_rate") > 0, F.col(p) / F.col(n) / F.col("overall_rate")).otherwise(1.0))

    return out.select(*by, "decile", relative("p", "n").alias("lift"), relative("cp", "cn").alias("cumulative_lift"), "overall_rate")


def gains(
    df: DataFrame, label: str, score: str, id: str, by: Sequence[str] = (), n_points: int = 100,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Share of positives in the best-scored part of the rows, at evenly spaced parts."""
    by = list(by)
    d = n_points - 1
    df = checked(df, label, score)
    order = plan_order(df, by, score, {"__p": F.count_if(F.col(label) == 1)}, tiebreak=id, rows_per_bucket=rows_per_bucket)
    ranked = order.with_totals(row_numbers(df.select(*by, score, id, label), order, "__rn", descending=True))
    # the first point whose cut-off floor(j * n / d) reaches this row
    point = F.expr(f"(__rn * {d} + __n - 1) div __n")
    hits = ranked.groupBy(*by, point.cast("int").alias("j")).agg(F.count_if(F.col(label) == 1).alias("p"))
    lists = hits.groupBy(*by).agg(F.collect_list(F.struct("j", "p")).alias("l"), F.sum("p").alias("P"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(d)), lambda j: F.struct(
        j.alias("point"),
        F.aggregate(F.filter("l", lambda e: e["j"] <= j), F.lit(0).cast("bigint"), lambda a, e: a + e["p"]).alias("c")))
    return lists.select(*by, "P", F.explode(rows).alias("e")).select(
        *by, F.col("e.point").alias("point"), (F.col("e.point") / float(d)).alias("percentage_population"),
        F.try_divide(F.col("e.c"), F.col("P")).alias("percentage_captured"))


# -- over metric tables, which have one row per model and split -------------------

def stability(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Population deviation of AUC, KS and Gini over the splits of each model."""
    return metrics.groupBy(by).agg(
        F.stddev_pop("roc_auc").alias("auc_stability"),
        F.stddev_pop("ks_statistic").alias("ks_stability"),
        F.stddev_pop("gini").alias("gini_stability"),
    )


def degradation(metrics: DataFrame, baseline: str = "train", by: str = "model", split: str = "split") -> DataFrame:
    """Baseline minus split, for AUC and KS; a model without the baseline split has no rows."""
    base = metrics.filter(F.col(split) == baseline).select(
        F.col(by).alias("__m"), F.col("roc_auc").alias("__auc"), F.col("ks_statistic").alias("__ks"))
    rest = metrics.filter(F.col(split) != baseline)
    out = rest.join(base, rest[by] == F.col("__m"))
    drop = F.col("__auc") - F.col("roc_auc")
    return out.select(
        by, split, drop.alias("auc_degradation"), (F.col("__ks") - F.col("ks_statistic")).alias("ks_degradation"),
        decay_alert(drop, F.col("__auc")).alias("alert"),
    )


def score_distribution(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"))


def _ranked(df: DataFrame, *keys) -> DataFrame:
    # one row per model: a single ordered task is the right size
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)))


def compare_models(metrics: DataFrame, sort_by: str = "roc_auc", split: str = "test") -> DataFrame:
    """Metrics of one split, best first."""
    key = F.asc(sort_by) if sort_by in LOWER_IS_BETTER else F.desc(sort_by)
    return metrics.filter(F.col("split") == split).select("model", *METRICS).orderBy(key, "model")


def leaderboard(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Models by AUC on one split, with rank and the F1 of the same model."""
    rows = metrics.filter(F.col("split") == split).select("model", "roc_auc", "f1")
    return _ranked(rows, F.desc("roc_auc"), "model").orderBy("rank")


def cv_leaderboard(fold_scores: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation of fold AUC per model, with columns joined by model name."""
    rows = fold_scores.groupBy("model").agg(F.avg("roc_auc").alias("cv_auc_mean"), F.stddev_pop("roc_auc").alias("cv_auc_std"))
    if extras is not None:
        rows = rows.join(F.broadcast(extras), "model", "left")
    return _ranked(rows, F.desc("cv_auc_mean"), "model").orderBy("rank")


def best_model(board: DataFrame, results: DataFrame) -> DataFrame:
    """Result rows of the first model of the board; if it has none, those of the first model."""
    names = results.select("model").distinct().join(board.select("model", "rank"), "model", "left")
    first = F.struct(F.coalesce(F.col("rank"), F.lit(2)) > 1, F.col("model"))
    return results.join(F.broadcast(names.agg(F.min_by("model", first).alias("model"))), "model")


def lights(metrics: DataFrame, by: Sequence[str] = ("model", "split"), names: Sequence[str] = ("roc_auc", "f1", "precision", "recall")) -> DataFrame:
    """(model, split, metric, value, light) for the metrics of a report."""
    return metrics.unpivot(list(by), list(names), "metric", "value").withColumn("light", traffic_light(F.col("value")))


def stability_matrix(metrics: DataFrame, splits: Sequence[str] = ("train", "test", "oot", "etrc")) -> DataFrame:
    """AUC per model (rows) and split (columns); the splits are named, so no extra job."""
    return metrics.groupBy("model").pivot("split", list(splits)).agg(F.first("roc_auc")).fillna(0.0, list(splits))


def risk_flags(metrics: DataFrame, model_order: Sequence[str], low_auc: float = 0.65, gap: float = 0.1) -> DataFrame:
    """Low best AUC; a train-test gap in the first of the first two models that has one; else "none"."""
    test = metrics.filter(F.col("split") == "test")
    best = test.agg(F.max_by("model", "roc_auc").alias("model"), F.max("roc_auc").alias("value"))
    low = best.filter(F.col("value") < low_auc).select(F.lit("low_auc").alias("flag"), "model", "value")
    first_two = list(model_order)[:2]
    wide = (
        metrics.filter(F.col("model").isin(first_two)).groupBy("model").agg(
            (F.max(F.when(F.col("split") == "train", F.col("roc_auc")))
             - F.max(F.when(F.col("split") == "test", F.col("roc_auc")))).alias("value"))
        .filter(F.col("value") > gap)
        .withColumn("at", F.array_position(F.array(*[F.lit(m) for m in first_two] or [F.lit("")]), F.col("model")))
    )
    over = wide.orderBy("at").limit(1).select(F.lit("overfit_gap").alias("flag"), "model", "value")
    found = low.unionByName(over)
    none = found.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit("none").alias("flag"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("value"))
    return found.unionByName(none)
