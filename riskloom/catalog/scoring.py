"""Queries on evaluation: two scorecards over all orders, in four splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import evaluate as H
from .frames import SCORED, scored
from .registry import query, rounded
from .sql import big, r

BY = ["model", "split"]

_COUNTS = """
cm AS (SELECT model, split, sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
  avg(-(CASE WHEN label = 1 THEN ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) ELSE ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END)) AS log_loss,
  avg((score - label) ** 2) AS brier FROM scored GROUP BY model, split)"""
_CUM = """
g AS (SELECT model, split, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY model, split, score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER p AS np, sum(neg) OVER p AS nn FROM g
  WINDOW w AS (PARTITION BY model, split ORDER BY score ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY model, split)),
rank_metrics AS (SELECT model, split, sum(pos * (cn - neg + neg / 2.0)) / (CAST(any_value(np) AS DOUBLE) * any_value(nn)) AS auc,
  max(abs(cp / CAST(np AS DOUBLE) - cn / CAST(nn AS DOUBLE))) * 100 AS ks FROM c GROUP BY model, split)"""
_METRICS = f"""WITH {SCORED}, {_COUNTS}, {_CUM},
m AS (SELECT cm.*, auc AS roc_auc, 2 * auc - 1 AS gini, ks AS ks_statistic, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1, brier AS brier_score
  FROM cm JOIN rank_metrics k ON k.model = cm.model AND k.split = cm.split)"""


def _pick(*names):
    return ", ".join(f'{r(chr(34) + n + chr(34))} AS "{n}"' for n in names)


def _metrics(spark, folder):
    return H.evaluate(scored(spark, folder), "label", "score", "pred", BY)


@query("unscored_rows", ["H12"], f"""WITH {SCORED} SELECT model, split, {big('count(*)')} AS n, {big('count(*) FILTER (id % 10 = 0)')} AS n_unscored,
{big('count(*) FILTER (id % 7 = 0)')} AS n_bad_labels FROM scored GROUP BY model, split""")
def unscored_rows(spark, folder):
    """What no metric can use; the metrics themselves fail on such rows."""
    holes = scored(spark, folder).withColumn("score", F.when(F.col("id") % 10 != 0, F.col("score"))).withColumn(
        "label", F.when(F.col("id") % 7 == 0, F.lit(2)).otherwise(F.col("label")))
    return H.unscored(holes, "label", "score", BY)


@query("confusion_matrix", ["H1"], f"WITH {SCORED}, {_COUNTS} SELECT model, split, {', '.join(f'{big(c)} AS {c}' for c in ('tn', 'fp', 'fn', 'tp'))} FROM cm")
def confusion_matrix(spark, folder):
    return H.confusion(scored(spark, folder), "label", "pred", BY)


@query("threshold_metrics", ["H2"], f"{_METRICS} SELECT model, split, {_pick('accuracy', 'precision', 'recall', 'f1')} FROM m")
def threshold_metrics(spark, folder):
    return rounded(H.threshold_metrics(scored(spark, folder), "label", "pred", BY))


@query("roc_auc", ["H3"], f"{_METRICS} SELECT model, split, {_pick('roc_auc')} FROM m")
def roc_auc(spark, folder):
    return rounded(H.roc_auc(scored(spark, folder), "label", "score", BY))


@query("roc_auc_overall_in_buckets", ["H3", "H6"], f"""WITH {SCORED}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))
SELECT {r('sum(pos * (cn - neg + neg / 2.0)) / (CAST(any_value(np) AS DOUBLE) * any_value(nn))')} AS roc_auc,
{r('max(abs(cp / CAST(np AS DOUBLE) - cn / CAST(nn AS DOUBLE))) * 100')} AS ks_statistic FROM c""")
def roc_auc_overall_in_buckets(spark, folder):
    """No grouping, and a bucket size that makes a small table take the path of a large one."""
    return rounded(H.evaluate(scored(spark, folder), "label", "score", "pred", rows_per_bucket=1000).select("roc_auc", "ks_statistic"))


_ROC = f"""WITH {SCORED}, {_CUM},
d AS (SELECT model, split, score, pos, neg, np, nn, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, lag(pos) OVER w AS before,
  lead(pos) OVER w AS np2, lead(neg) OVER w AS nn2 FROM c WINDOW w AS (PARTITION BY model, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, split, {r('cn / CAST(nn AS DOUBLE)')} AS fpr, {r('cp / CAST(np AS DOUBLE)')} AS tpr FROM d
WHERE before IS NULL OR np2 IS NULL OR np2 <> pos OR nn2 <> neg
UNION ALL SELECT DISTINCT model, split, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scored"""


@query("roc_curve", ["H4"], _ROC)
def roc_curve(spark, folder):
    return rounded(H.roc_curve(scored(spark, folder), "label", "score", BY).drop("threshold"))


@query("roc_curve_in_buckets", ["H4"], _ROC)
def roc_curve_in_buckets(spark, folder):
    return rounded(H.roc_curve(scored(spark, folder), "label", "score", BY, rows_per_bucket=200).drop("threshold"))


@query("gini", ["H5"], f"{_METRICS} SELECT model, split, {_pick('gini')} FROM m")
def gini(spark, folder):
    return rounded(_metrics(spark, folder).select(*BY, "gini"))


@query("ks_statistic", ["H6", "H8"], f"""{_METRICS} SELECT model, split, {_pick('ks_statistic')}, CASE WHEN ks < 20 THEN 'poor' WHEN ks < 40 THEN 'average'
WHEN ks < 50 THEN 'good' WHEN ks < 60 THEN 'very_good' ELSE 'excellent_check_overfit' END AS quality FROM (SELECT *, ks_statistic AS ks FROM m)""")
def ks_statistic(spark, folder):
    ks = H.ks_statistic(scored(spark, folder), "label", "score", BY)
    return rounded(ks.withColumn("quality", bands.ks_quality(F.col("ks_statistic"))))


@query("ks_curve", ["H7"], f"""WITH {SCORED}, {_CUM} SELECT model, split, score AS threshold, {r('cp / CAST(np AS DOUBLE)')} AS pos_cdf,
{r('cn / CAST(nn AS DOUBLE)')} AS neg_cdf, {r('abs(cp / CAST(np AS DOUBLE) - cn / CAST(nn AS DOUBLE))')} AS ks FROM c""")
def ks_curve(spark, folder):
    return rounded(H.ks_curve(scored(spark, folder), "label", "score", BY))


@query("log_loss", ["H9"], f"{_METRICS} SELECT model, split, {_pick('log_loss')} FROM m")
def log_loss(spark, folder):
    return rounded(_metrics(spark, folder).select(*BY, "log_loss"))


@query("brier_score", ["H10"], f"{_METRICS} SELECT model, split, {_pick('brier_score')} FROM m")
def brier_score(spark, folder):
    return rounded(_metrics(spark, folder).select(*BY, "brier_score"))


def _ratio(a, b):
    return f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0 END"


@query("classification_report", ["H11"], f"""WITH {SCORED}, {_COUNTS},
s AS (SELECT model, split, '1' AS class, {_ratio('tp', 'tp + fp')} AS p, {_ratio('tp', 'tp + fn')} AS rec, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f, tp + fn AS n, tp + tn AS hits, tp + tn + fp + fn AS a FROM cm
UNION ALL SELECT model, split, '0', {_ratio('tn', 'tn + fn')}, {_ratio('tn', 'tn + fp')}, {_ratio('2 * tn', '2 * tn + fp + fn')}, tn + fp, tp + tn, tp + tn + fp + fn FROM cm),
u AS (SELECT model, split, class, p, rec, f, n FROM s
UNION ALL SELECT DISTINCT model, split, 'accuracy', hits / CAST(a AS DOUBLE), hits / CAST(a AS DOUBLE), hits / CAST(a AS DOUBLE), a FROM s
UNION ALL SELECT model, split, 'macro avg', avg(p), avg(rec), avg(f), sum(n) FROM s GROUP BY 1, 2
UNION ALL SELECT model, split, 'weighted avg', sum(p * n) / sum(n), sum(rec * n) / sum(n), sum(f * n) / sum(n), sum(n) FROM s GROUP BY 1, 2)
SELECT model, split, class, {r('p')} AS "precision", {r('rec')} AS recall, {r('f')} AS f1, {big('n')} AS support FROM u""")
def classification_report(spark, folder):
    return rounded(H.classification_report(H.confusion(scored(spark, folder), "label", "pred", BY), BY))


ALL = H.METRICS


@query("all_metrics", ["H12", "H13"], f"{_METRICS} SELECT model, split, {_pick(*ALL)}, {', '.join(f'{big(c)} AS {c}' for c in ('tn', 'fp', 'fn', 'tp'))} FROM m")
def all_metrics(spark, folder):
    return rounded(_metrics(spark, folder).drop("confusion"))


@query("light_metrics_by_split", ["H13"], f"{_METRICS} SELECT model, split, {_pick('accuracy', 'precision', 'recall', 'f1', 'roc_auc')} FROM m")
def light_metrics_by_split(spark, folder):
    return rounded(H.light_metrics(_metrics(spark, folder), BY))


@query("metric_stability", ["H14"], f"""{_METRICS} SELECT model, {r('stddev_pop(roc_auc)')} AS auc_stability, {r('stddev_pop(ks_statistic)')} AS ks_stability,
{r('stddev_pop(gini)')} AS gini_stability FROM m GROUP BY model""")
def metric_stability(spark, folder):
    return rounded(H.stability(_metrics(spark, folder)))


@query("metric_degradation", ["H15", "H17"], f"""{_METRICS} SELECT a.model, a.split, {r('b.roc_auc - a.roc_auc')} AS auc_degradation, {r('b.ks_statistic - a.ks_statistic')} AS ks_degradation,
CASE WHEN (b.roc_auc - a.roc_auc) / b.roc_auc > 0.20 THEN 'act' WHEN (b.roc_auc - a.roc_auc) / b.roc_auc > 0.10 THEN 'warn' ELSE 'ok' END AS alert
FROM m a JOIN m b ON a.model = b.model AND b.split = 'train' WHERE a.split <> 'train'""")
def metric_degradation(spark, folder):
    return rounded(H.degradation(_metrics(spark, folder)))


@query("score_distribution", ["H16"], f"WITH {SCORED} SELECT model, split, {r('avg(score)')} AS score_mean, {r('stddev_pop(score)')} AS score_std FROM scored GROUP BY model, split")
def score_distribution(spark, folder):
    return rounded(H.score_distribution(scored(spark, folder), "score", BY))


_RANKED = """
rk AS (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY model, split) AS n,
  sum(label) OVER (PARTITION BY model, split) AS np FROM scored)"""
_LIFT = f"""WITH {SCORED}, {_RANKED}, b AS (SELECT *, least((rn - 1) // (n // 10), 9) + 1 AS decile FROM rk),
d AS (SELECT model, split, decile, count(*) AS k, sum(label) AS p, any_value(np) / CAST(any_value(n) AS DOUBLE) AS rate FROM b GROUP BY 1, 2, 3),
e AS (SELECT *, sum(k) OVER w AS ck, sum(p) OVER w AS cp FROM d WINDOW w AS (PARTITION BY model, split ORDER BY decile))
SELECT model, split, CAST(decile AS INTEGER) AS decile, {r('p / CAST(k AS DOUBLE) / rate')} AS lift, {r('cp / CAST(ck AS DOUBLE) / rate')} AS cumulative_lift, {r('rate')} AS overall_rate FROM e"""


@query("lift_by_decile", ["H18"], _LIFT)
def lift_by_decile(spark, folder):
    return rounded(H.lift(scored(spark, folder), "label", "score", "id", BY))


@query("lift_by_decile_in_buckets", ["H18"], _LIFT)
def lift_by_decile_in_buckets(spark, folder):
    return rounded(H.lift(scored(spark, folder), "label", "score", "id", BY, rows_per_bucket=300))


@query("cumulative_gains", ["H19"], f"""WITH {SCORED}, {_RANKED}, t AS (SELECT DISTINCT model, split, n, np FROM rk), j AS (SELECT unnest(range(0, 100)) AS point),
cuts AS (SELECT *, (point * n) // 99 AS m FROM t, j)
SELECT c.model, c.split, CAST(c.point AS INTEGER) AS point, {r('c.point / CAST(99 AS DOUBLE)')} AS percentage_population,
{r('coalesce(sum(k.label), 0) / CAST(any_value(c.np) AS DOUBLE)')} AS percentage_captured
FROM cuts c LEFT JOIN rk k ON k.model = c.model AND k.split = c.split AND k.rn <= c.m GROUP BY c.model, c.split, c.point""")
def cumulative_gains(spark, folder):
    return rounded(H.gains(scored(spark, folder), "label", "score", "id", BY))


@query("model_comparison", ["H20"], f"{_METRICS} SELECT model, {_pick(*ALL)} FROM m WHERE split = 'test'")
def model_comparison(spark, folder):
    return rounded(H.compare_models(_metrics(spark, folder), "log_loss"))


_BOARD = "board AS (SELECT model, roc_auc, f1, row_number() OVER (ORDER BY roc_auc DESC, model) AS rank FROM m WHERE split = 'test')"


@query("leaderboard", ["H21", "H24"], f"{_METRICS}, {_BOARD} SELECT model, {_pick('roc_auc', 'f1')}, CAST(rank AS INTEGER) AS rank FROM board")
def leaderboard(spark, folder):
    return rounded(H.leaderboard(_metrics(spark, folder)))


@query("cross_validation_leaderboard", ["H22"], f"""{_METRICS}, f AS (SELECT model, avg(roc_auc) AS cv_auc_mean, stddev_pop(roc_auc) AS cv_auc_std FROM m GROUP BY model)
SELECT f.model, {r('cv_auc_mean')} AS cv_auc_mean, {r('cv_auc_std')} AS cv_auc_std, {r('t.f1')} AS test_f1, CAST(row_number() OVER (ORDER BY cv_auc_mean DESC, f.model) AS INTEGER) AS rank
FROM f LEFT JOIN m t ON t.model = f.model AND t.split = 'test'""")
def cross_validation_leaderboard(spark, folder):
    """The four splits take the place of folds."""
    m = _metrics(spark, folder)
    extras = m.filter(F.col("split") == "test").select("model", F.col("f1").alias("test_f1"))
    return rounded(H.cv_leaderboard(m.select("model", "roc_auc"), extras))


@query("best_model", ["H23"], f"{_METRICS}, {_BOARD} SELECT m.model, m.split, {r('m.roc_auc')} AS roc_auc FROM m JOIN board b ON b.model = m.model WHERE b.rank = 1")
def best_model(spark, folder):
    m = _metrics(spark, folder)
    return rounded(H.best_model(H.leaderboard(m), m).select("model", "split", "roc_auc"))


@query("metric_lights", ["H25"], f"""{_METRICS}, u AS ({' UNION ALL '.join(f"SELECT model, split, '{n}' AS metric, {chr(34)}{n}{chr(34)} AS value FROM m" for n in ('roc_auc', 'f1', 'precision', 'recall'))})
SELECT model, split, metric, {r('value')} AS value, CASE WHEN value >= 0.75 THEN 'good' WHEN value >= 0.60 THEN 'warn' ELSE 'bad' END AS light FROM u""")
def metric_lights(spark, folder):
    return rounded(H.lights(_metrics(spark, folder)))


@query("stability_matrix", ["H26"], f"""{_METRICS} SELECT model, {', '.join(f"{r(f'max(CASE WHEN split = {chr(39)}{s}{chr(39)} THEN roc_auc END)')} AS {s}" for s in ('train', 'test', 'oot', 'etrc'))}
FROM m GROUP BY model""")
def stability_matrix(spark, folder):
    return rounded(H.stability_matrix(_metrics(spark, folder)))


@query("risk_flags", ["H27"], f"""{_METRICS}, flags AS (
SELECT * FROM (SELECT 'low_auc' AS flag, model, roc_auc AS value FROM m WHERE split = 'test' ORDER BY roc_auc DESC, model LIMIT 1) WHERE value < 0.65
UNION ALL SELECT * FROM (SELECT 'overfit_gap', a.model, a.roc_auc - b.roc_auc AS gap FROM m a JOIN m b ON a.model = b.model AND a.split = 'train' AND b.split = 'test'
  WHERE a.roc_auc - b.roc_auc > 0.1 ORDER BY CASE a.model WHEN 'price' THEN 0 ELSE 1 END LIMIT 1))
SELECT flag, model, {r('value')} AS value FROM flags UNION ALL SELECT 'none', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM flags)""")
def risk_flags(spark, folder):
    return rounded(H.risk_flags(_metrics(spark, folder), ["price", "blend"]))
