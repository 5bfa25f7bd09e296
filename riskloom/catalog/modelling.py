"""Queries on models and explanations.

Models are fitted with their published presets, 5 folds and the quick search of 20 trials x 3
folds. Such fits have no SQL twin; where a run has an exact side, such as which fold held a row
out, that side is compared, and fits whose optimum has a closed form are compared whole.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import explain as K
from ..operators import models as J
from ..operators.target import stratified_folds, stratified_split
from ..operators.workflow import TARGET, run_workflow
from ..session import fresh_path, settle
from ..sources.artifacts import load_metadata, load_model, score_table
from .frames import ACCOUNTS, accounts
from .profiling import _checks_sql, messy
from .registry import query, rounded, table
from .sql import big, hash_rank, r

FEATURES = ["price", "balance", "segment", "priority", "nation"]


def _accounts(spark, folder):
    return accounts(spark, folder).select("id", *FEATURES, "y")


def _train(spark, folder, models=tuple(J.MODELS)):
    split = stratified_split(_accounts(spark, folder), "y", ["id"])
    return J.train(split, "y", models=models, keep=["id"])


def _released(run, result):
    """A result of a run, written out so that the run's persisted table can go."""
    try:
        return settle(result(run), "result")
    finally:
        run.release()


_SPLIT = f"""ranked AS (SELECT id, y, {hash_rank('id', 42, 'y')} AS rk, count(*) OVER (PARTITION BY y) AS n FROM acc),
splits AS (SELECT *, CASE WHEN rk < (12 * n + 10) // 20 THEN 'train' WHEN rk < (16 * n + 10) // 20 THEN 'test'
  WHEN rk < (18 * n + 10) // 20 THEN 'oot' ELSE 'etrc' END AS split FROM ranked)"""


@query("trained_model_metrics", ["J1", "J2", "J3", "J4", "J5"])
def trained_model_metrics(spark, folder):
    return _released(_train(spark, folder), lambda run: rounded(run.metrics.drop("confusion")))


@query("trained_model_support", ["J5"], f"""WITH {ACCOUNTS}, {_SPLIT}
SELECT m AS model, split, {big('count(*)')} AS n, {big('sum(y)')} AS n_positive, true AS all_scored
FROM splits, (SELECT unnest(['GradientBoosting', 'LightGBM', 'LogisticRegression', 'RandomForest', 'XGBoost']) AS m) GROUP BY m, split""")
def trained_model_support(spark, folder):
    """Every model scored every row of every split once, with a probability."""
    return _released(_train(spark, folder), lambda run: run.scored.groupBy("model", "split").agg(
        F.countDistinct("id").alias("n"), F.sum(F.col("y").cast("bigint")).alias("n_positive"),
        F.every(F.col("score").between(0, 1)).alias("all_scored")))


@query("trained_leaderboard", ["J5"])
def trained_leaderboard(spark, folder):
    return _released(_train(spark, folder), lambda run: rounded(run.leaderboard()))


@query("feature_importance", ["J10"])
def feature_importance(spark, folder):
    return _released(_train(spark, folder), lambda run: rounded(run.importance()))


def _folded(spark, folder, k=5):
    acc = stratified_folds(_accounts(spark, folder), "y", ["id"], k)
    return J.assemble(acc, "y", acc, ["id", "fold"])[1]


def _held_out(spark, folder):
    """Out-of-fold rows of all models."""
    table = _folded(spark, folder)
    try:
        return settle(J.cross_validate_models(table, "y", k=5, keep=["id"]), "result")
    finally:
        table.unpersist()


@query("cross_validation", ["J7"])
def cross_validation(spark, folder):
    scores = J.evaluate(_held_out(spark, folder), "y", "score", "pred", ["model", "fold"])
    return rounded(scores.select("model", "fold", "roc_auc"))


@query("out_of_fold_scores", ["J8"], f"""WITH {ACCOUNTS}, ranked AS (SELECT id, y, {hash_rank('id', 42, 'y')} AS rk, count(*) OVER (PARTITION BY y) AS n FROM acc)
SELECT m AS model, id, CAST(y AS INTEGER) AS y, CAST(CASE WHEN rk < n // 5 THEN 0 WHEN rk < n * 2 // 5 THEN 1 WHEN rk < n * 3 // 5 THEN 2 WHEN rk < n * 4 // 5 THEN 3 ELSE 4 END AS INTEGER) AS fold, true AS scored
FROM ranked, (SELECT unnest(['GradientBoosting', 'LightGBM', 'LogisticRegression', 'RandomForest', 'XGBoost']) AS m)""")
def out_of_fold_scores(spark, folder):
    """Each row once a model, scored by the fit that did not see its fold."""
    return _held_out(spark, folder).select("model", "id", "y", "fold", F.col("score").between(0, 1).alias("scored"))


@query("hyperparameter_search", ["J9"])
def hyperparameter_search(spark, folder):
    held = _folded(spark, folder, 3)
    found = J.quick_tune(held, "y", "LogisticRegression")
    held.unpersist()
    return rounded(found.table(spark))


@query("experiment_run", ["J6", "A4"])
def experiment_run(spark, folder):
    acc = _accounts(spark, folder)
    split = stratified_split(acc, "y", ["id"])
    of = lambda name: split.filter(F.col("split") == name).drop("split")
    config = J.RunConfig(artifact_dir=fresh_path(spark, "experiments"))  # the whole search: up to 50 trials of 5 folds for each model
    run = J.run_experiment(of("train"), "y", ["id"], config, of("test"), others={name: of(name) for name in ("oot", "etrc")})
    saved = load_metadata(spark, run.path).select("model", F.size("cv_scores").alias("n_folds"), F.size("feature_names").alias("n_features"))
    for name in ("oot", "etrc"):
        held = run.other_metrics.filter(F.col("split") == name)
        saved = saved.join(held.select("model", *[F.col(m).alias(c.replace("test", name)) for m, c in J.TEST_COLUMNS.items()]), "model")
    return _released(run, lambda run: rounded(run.leaderboard.join(saved, "model").drop("training_time_s", "model_id")))


@query("saved_model_scores", ["A4", "A5"], f"""WITH {ACCOUNTS} SELECT id, true AS same_score FROM acc""")
def saved_model_scores(spark, folder):
    """A loaded pipeline scores raw rows exactly as the one that was saved."""
    from ..sources.artifacts import save_experiment

    acc = _accounts(spark, folder)
    run = _train(spark, folder, ("LogisticRegression",))
    path = save_experiment(spark, fresh_path(spark, "saved"), "one", run.pipelines, [])
    loaded = score_table(load_model(path, "LogisticRegression"), acc, ["id"])
    held = run.scored.select("id", F.col("score").alias("before"))
    same = loaded.join(held, "id").select("id", (F.abs(F.col("score") - F.col("before")) < 1e-12).alias("same_score"))
    return _released(run, lambda _: same)


@query("failed_model_row", ["J5"], """SELECT * FROM (VALUES ('LogisticRegression', 'trained', false), ('RandomForest', 'failed', true)) AS t(model, status, has_error)
WHERE (SELECT count(*) FROM orders) > 0""")
def failed_model_row(spark, folder):
    """A model that cannot be trained is a row that says so."""
    split = stratified_split(_accounts(spark, folder), "y", ["id"])
    run = J.train(split, "y", models=("LogisticRegression", "RandomForest"), params={"RandomForest": {"max_depth": 31}}, keep=["id"])
    return _released(run, lambda r: r.status().select("model", "status", F.col("error").isNotNull().alias("has_error")))


# -- fits with a closed form ------------------------------------------------------
# One 0/1 input: its small size is the subject. It makes the fitted scores the class shares of its two levels.

_FLAG = """flag AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS x,
CASE WHEN o_orderstatus = 'F' OR o_custkey % 2 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y FROM orders)"""


def _flagged(spark, folder):
    o = table(spark, folder, "orders")
    late = (F.col("o_orderstatus") == "F") | ((F.col("o_custkey") % 2 == 0) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("x"), late.cast("int").alias("y"))


def _fit_flag(spark, folder, model, params):
    rows = _flagged(spark, folder).withColumns({"split": F.lit("train"), "level": F.col("x")})
    run = J.train(rows, "y", models=(model,), params={model: params}, keep=["id", "level"])
    scores = run.scored.groupBy(F.col("level").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 3).alias("low"), F.round(F.max("score"), 3).alias("high"))
    return _released(run, lambda _: scores)


ONE_TREE = {"n_estimators": 1, "max_features": None, "bootstrap": False}
_RATES = f"WITH {_FLAG} SELECT CAST(x AS INTEGER) AS x, {big('count(*)')} AS n, round(avg(y), 3) AS low, round(avg(y), 3) AS high FROM flag GROUP BY x"


@query("saturated_logistic_scores", ["J1"], _RATES)
def saturated_logistic_scores(spark, folder):
    """Without a penalty, logistic regression on one 0/1 input scores each level with its class share."""
    return _fit_flag(spark, folder, "LogisticRegression", {"penalty": None})


@query("stump_forest_scores", ["J2"], _RATES)
def stump_forest_scores(spark, folder):
    """A forest of one tree on one 0/1 input scores each level with its class share, as the levels differ in their larger class."""
    return _fit_flag(spark, folder, "RandomForest", ONE_TREE)


@query("one_boosting_round_scores", ["J3", "J4"], f"""WITH {_FLAG}, leaf AS (SELECT x, count(*) AS n, avg(2 * y - 1) AS m FROM flag GROUP BY x)
SELECT CAST(x AS INTEGER) AS x, {big('n')} AS n, round(1 / (1 + exp(-2 * m)), 3) AS low, round(1 / (1 + exp(-2 * m)), 3) AS high FROM leaf""")
def one_boosting_round_scores(spark, folder):
    """The first tree fits the labels -1 and 1 by their means; a margin m scores 1 / (1 + exp(-2 m))."""
    return _fit_flag(spark, folder, "GradientBoosting", {"n_estimators": 1})


_FOLD_AUC = f"""WITH {_FLAG}, ranked AS (SELECT id, x, y, {hash_rank('id', 42, 'y')} AS rk, count(*) OVER (PARTITION BY y) AS n FROM flag),
folds AS (SELECT id, x, y, CASE WHEN rk < n // 5 THEN 0 WHEN rk < n * 2 // 5 THEN 1 WHEN rk < n * 3 // 5 THEN 2 WHEN rk < n * 4 // 5 THEN 3 ELSE 4 END AS fold FROM ranked),
held AS (SELECT f.fold, g.x, avg(g.y) AS score FROM (SELECT DISTINCT fold FROM folds) f JOIN folds g ON g.fold <> f.fold GROUP BY f.fold, g.x),
oof AS (SELECT o.id, o.y, o.fold, h.score FROM folds o JOIN held h ON h.fold = o.fold AND h.x = o.x),
counts AS (SELECT fold, score, sum(y) AS p, sum(1 - y) AS q FROM oof GROUP BY fold, score),
auc AS (SELECT a.fold, sum(CASE WHEN b.score < a.score THEN a.p * b.q WHEN b.score = a.score THEN a.p * b.q / 2.0 ELSE 0 END) / (max(t.p) * max(t.q)) AS roc_auc
FROM counts a JOIN counts b ON a.fold = b.fold JOIN (SELECT fold, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(q) AS DOUBLE) AS q FROM counts GROUP BY fold) t ON t.fold = a.fold GROUP BY a.fold)"""


def _flag_folds(spark, folder):
    return J.assemble(stratified_folds(_flagged(spark, folder), "y", ["id"], 5), "y", _flagged(spark, folder), ["id", "fold"])[1]


@query("stump_out_of_fold_scores", ["J8"], f"{_FOLD_AUC} SELECT id, CAST(fold AS INTEGER) AS fold, {r('score')} AS score FROM oof")
def stump_out_of_fold_scores(spark, folder):
    """Each row's score is the class share of its level in the other folds: a leak of its own fold would show."""
    held = _flag_folds(spark, folder)
    oof = J.out_of_fold(held, "y", "RandomForest", ONE_TREE, k=5, keep=["id"])
    out = settle(rounded(oof.select("id", "fold", "score")), "result")
    held.unpersist()
    return out


@query("stump_fold_auc", ["J7", "J9"], f"{_FOLD_AUC} SELECT CAST(fold AS INTEGER) AS fold, {r('roc_auc')} AS roc_auc FROM auc")
def stump_fold_auc(spark, folder):
    from ..plans.rows import local_table

    held = _flag_folds(spark, folder)
    found = J.tune(held, "y", "RandomForest", n_trials=2, k=5, space={"max_depth": {"type": "int", "low": 1, "high": 3}},
                   fixed=ONE_TREE)
    held.unpersist()
    return rounded(local_table(spark, enumerate(found.cv_scores), "fold int, roc_auc double"))


@query("experiment_of_stumps", ["J6"], f"""{_FOLD_AUC}, rate AS (SELECT x, avg(y) AS p FROM flag GROUP BY x),
whole AS (SELECT f.y, r.p FROM flag f JOIN rate r ON r.x = f.x),
test AS (SELECT sum(CASE WHEN b.p < a.p THEN a.n * b.m WHEN b.p = a.p THEN a.n * b.m / 2.0 ELSE 0 END) / (sum(CASE WHEN b.p = a.p THEN a.n END) * sum(CASE WHEN a.p = b.p THEN b.m END)) AS auc
FROM (SELECT p, sum(y) AS n FROM whole GROUP BY p) a, (SELECT p, sum(1 - y) AS m FROM whole GROUP BY p) b)
SELECT 'RandomForest' AS model, {r('avg(roc_auc)')} AS cv_auc_mean, {r('stddev_pop(roc_auc)')} AS cv_auc_std, (SELECT {r('auc')} FROM test) AS test_auc,
{big('(SELECT count(*) FROM oof)')} AS n_held_out, 2 AS trials, 'searched, resumed' AS state FROM auc""")
def experiment_of_stumps(spark, folder):
    """A configured run whole, search, folds, fit, test and board, twice on one ledger: the second run fits nothing."""
    rows = _flagged(spark, folder)
    config = J.RunConfig(models=("RandomForest",), trials=2, params={"RandomForest": ONE_TREE}, artifact_dir=fresh_path(spark, "experiments"),
                         spaces={"RandomForest": {"max_depth": {"type": "int", "low": 1, "high": 3}}})
    first = J.run_experiment(rows, "y", ["id"], config, rows, experiment_id="stumps")
    first.release()
    again = J.run_experiment(rows, "y", ["id"], config, rows, experiment_id="stumps")
    done = sum(again.ledger.done(f"RandomForest/trial-{i}") for i in range(9))
    state = "searched, resumed" if first.ledger.made and not again.ledger.made else "fitted again"
    board = again.leaderboard.select("model", "cv_auc_mean", "cv_auc_std", "test_auc", F.lit(again.oof.count()).alias("n_held_out"),
                                     F.lit(done).alias("trials"), F.lit(state).alias("state"))
    return _released(again, lambda _: rounded(board))


@query("flag_importance", ["J10"], f"""WITH {_FLAG}, s AS (SELECT x, avg(y) AS p FROM flag GROUP BY x), sd AS (SELECT stddev_pop(x) AS sd FROM flag)
SELECT 'x' AS feature, round((SELECT ln(p / (1 - p)) FROM s WHERE x = 1) * sd - (SELECT ln(p / (1 - p)) FROM s WHERE x = 0) * sd, 2) AS importance FROM sd""")
def flag_importance(spark, folder):
    """The coefficient of a standardised 0/1 input is the log odds ratio of its levels times its deviation."""
    run = J.train(_flagged(spark, folder).withColumn("split", F.lit("train")), "y", models=("LogisticRegression",),
                  params={"LogisticRegression": {"penalty": None}}, keep=["id"])
    return _released(run, lambda r: r.importance().select("feature", F.round("importance", 2).alias("importance")))


# -- explanations -----------------------------------------------------------------

# A fixed scorecard, so that SQL can state the explanation of it.
COEF = {"price": 0.4, "balance": -0.25, "months": 0.05}
INTERCEPT = -0.3


def _inputs(spark, folder):
    return accounts(spark, folder).select(
        "id", (F.col("price") / 99991).alias("price"), (F.coalesce("balance", F.lit(0.0)) / 997).alias("balance"),
        F.month("day").cast("double").alias("months"))


_INPUTS = f"""{ACCOUNTS}, x AS (SELECT id, price / 99991 AS price, coalesce(balance, 0) / 997 AS balance, CAST(month(day) AS DOUBLE) AS months FROM acc),
bg AS (SELECT * FROM x ORDER BY md5(concat(id, '|42')) LIMIT 100), mu AS (SELECT avg(price) AS price, avg(balance) AS balance, avg(months) AS months FROM bg),
long AS ({' UNION ALL '.join(f"SELECT x.id, '{f}' AS feature, x.{f} AS value, (x.{f} - mu.{f}) * CAST({c} AS DOUBLE) AS contribution FROM x, mu" for f, c in COEF.items())}),
base AS (SELECT {INTERCEPT} + {' + '.join(f'mu.{f} * {c}' for f, c in COEF.items())} AS b FROM mu)"""


def _linear(spark, folder):
    x = _inputs(spark, folder)
    rows = K.background(x, list(COEF), ["id"])
    return K.linear(x, ["id"], COEF, INTERCEPT, K.means(rows))


@query("background_sample", ["K1"], f"WITH {_INPUTS} SELECT {', '.join(f'{r(f)} AS {f}' for f in COEF)} FROM bg")
def background_sample(spark, folder):
    from ..plans.rows import local_table

    rows = K.background(_inputs(spark, folder), list(COEF), ["id"])
    return rounded(local_table(spark, rows, "price double, balance double, months double"))


@query("linear_contributions", ["K2"], f"WITH {_INPUTS} SELECT id, feature, {r('value')} AS value, {r('contribution')} AS contribution FROM long")
def linear_contributions(spark, folder):
    return rounded(K.unfold(_linear(spark, folder), ["id"]))


@query("linear_additivity", ["K2"], f"""WITH {_INPUTS} SELECT x.id, {r(f"{INTERCEPT} + " + ' + '.join(f'x.{f} * {c}' for f, c in COEF.items()))} AS prediction, {r('b')} AS base_value FROM x, base""")
def linear_additivity(spark, folder):
    """Base plus contributions is the model's own log-odds."""
    e = _linear(spark, folder)
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"])
    return rounded(e.select("id", total.alias("prediction"), "base_value"))


def _nonlinear(df):
    z = F.col("p_size") * 0.05 + (F.col("p_retailprice") - 950) * 0.02 + F.col("p_size") * (F.col("p_retailprice") - 950) * 0.001
    return df.withColumn("score", 1 / (1 + F.exp(-z)))


def _f(s, p):
    return f"(1 / (1 + exp(-({s} * CAST(0.05 AS DOUBLE) + ({p} - 950) * CAST(0.02 AS DOUBLE) + {s} * ({p} - 950) * CAST(0.001 AS DOUBLE)))))"


@query("model_agnostic_contributions", ["K3"], f"""WITH bg AS (SELECT p_size AS s, p_retailprice AS p FROM part ORDER BY md5(concat(p_partkey, '|42')) LIMIT 100),
e AS (SELECT p_partkey, avg({_f('p_size', 'p_retailprice')}) AS prediction, avg({_f('s', 'p')}) AS base_value,
avg({_f('p_size', 'p_retailprice')} - {_f('s', 'p_retailprice')} + {_f('p_size', 'p')} - {_f('s', 'p')}) / 2 AS size_part,
avg({_f('p_size', 'p_retailprice')} - {_f('p_size', 'p')} + {_f('s', 'p_retailprice')} - {_f('s', 'p')}) / 2 AS price_part FROM part, bg GROUP BY p_partkey)
SELECT p_partkey, {r('prediction')} AS prediction, {r('base_value')} AS base_value, {r('size_part')} AS size_part, {r('price_part')} AS price_part FROM e""")
def model_agnostic_contributions(spark, folder):
    p = table(spark, folder, "part")
    cols = ["p_size", "p_retailprice"]
    e = K.agnostic(p, ["p_partkey"], cols, _nonlinear, K.background(p, cols, ["p_partkey"]), method=K.EXACT)
    return rounded(e.select("p_partkey", "prediction", "base_value", F.col("contributions")[0]["contribution"].alias("size_part"),
                            F.col("contributions")[1]["contribution"].alias("price_part")))


LIGHT = {"LogisticRegression": {"max_iter": 20}, "RandomForest": {"n_estimators": 10, "max_depth": 5},
         **{m: {"n_estimators": 5} for m in ("GradientBoosting", "XGBoost", "LightGBM")}}


def _customer_orders(spark, folder):
    """Twelve inputs of each customer with orders; y marks one whose orders are dearer than 140,000 on average."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    price = F.col("o_totalprice")
    facts = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max(price).alias("dearest"), F.min(price).alias("cheapest"), F.stddev_pop(price).alias("spread"),
        *[F.avg((F.col("o_orderpriority") == p).cast("double")).alias(f"is_{p[0]}") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")],
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("finished"), F.min(F.month("o_orderdate")).cast("double").alias("month"),
        (F.avg(price) > 140_000).cast("int").alias("y"))
    return facts.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("id"), "n", "dearest", "cheapest", "spread", "is_1", "is_2", "is_3", "finished", "month",
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), "y", F.lit("train").alias("split"))


@query("explained_models", ["K3"], """SELECT id, model, 12 AS n_features, 'permutation' AS method, true AS adds_up, true AS as_linear
FROM (SELECT DISTINCT o_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey),
(SELECT unnest(['GradientBoosting', 'LightGBM', 'LogisticRegression', 'RandomForest', 'XGBoost']) AS m) AS t(model)""")
def explained_models(spark, folder):
    """Contributions of twelve columns to the margin of five fitted models: with the base they add up to the prediction
    of every row. Those to a logistic model's log-odds are coefficient x (value - background mean), summed over each column's slots."""
    rows = _customer_orders(spark, folder)
    run = J.train(rows, "y", params=LIGHT, keep=["id"])
    lr = run.classifiers["LogisticRegression"]
    groups = K.slot_groups(run.pipelines["LogisticRegression"])
    flat = run.table.select("id", vector_to_array("features").alias("x"))
    pool = flat.withColumn("h", K.row_hash(["id"], 42)).orderBy("h").limit(20).select("x").collect()
    centre = K.means([list(p["x"]) for p in pool])
    coef, at, parts = [float(v) for v in lr.coefficients], 0, []
    for _, slots in groups:
        parts.append(sum(((F.col("x")[i] - F.lit(centre[i])) * F.lit(coef[i]) for i in range(at, at + len(slots))), F.lit(0.0)))
        at += len(slots)
    linear = flat.select("id", F.array(*parts).alias("linear"))
    out = None
    for name in run.classifiers:
        e = K.explain_model(run, name, ["id"], n_background=20, n_permutations=4, output="margin")
        raw = run.classifiers[name].transform(run.table).select("id", vector_to_array("rawPrediction")[1].alias("raw"))
        total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"])
        near = lambda a, b: F.abs(a - b) < 1e-9
        same = F.forall(F.zip_with("contributions", "linear", lambda c, v: F.abs(c["contribution"] - v) < 1e-9), lambda t: t)
        part = e.join(raw, "id").join(linear, "id").select(
            "id", F.lit(name).alias("model"), F.size("contributions").alias("n_features"), "method",
            (near(total, F.col("prediction")) & near(F.col("raw"), F.col("prediction"))).alias("adds_up"),
            same.alias("as_linear") if name == "LogisticRegression" else F.lit(True).alias("as_linear"))
        out = part if out is None else out.unionByName(part)
    return _released(run, lambda _: out)


MESSY_CHECKS = _checks_sql()
_NO_FEATURE = "is_constant OR is_date_like OR is_identifier OR is_near_zero_variance"
_CANDIDATES = "FROM checks WHERE \"column\" NOT IN ('status', 'row_id')"


@query("whole_run", ["B6", "B7", "B8", "C1", "C4", "H4", "J5"], MESSY_CHECKS + f""", acc AS (SELECT row_id AS id, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS y FROM messy), {_SPLIT}
SELECT m AS model, split, {big('count(*)')} AS n, {big('sum(y)')} AS n_positive, {r('avg(y)')} AS positive_share,
{big(f'(SELECT count(*) {_CANDIDATES} AND ({_NO_FEATURE}))')} AS n_dropped, {big(f'(SELECT count(*) {_CANDIDATES} AND NOT ({_NO_FEATURE}))')} AS n_features,
true AS curve_is_whole FROM splits, (SELECT unnest(['LogisticRegression', 'RandomForest']) AS m) GROUP BY m, split""")
def whole_run(spark, folder):
    """One call from raw orders to scored splits; each ROC curve runs from no row to all rows of its split."""
    out = run_workflow(messy(spark, folder), "status", ["row_id"], positive_class="F", models=("LogisticRegression", "RandomForest"), params=LIGHT)
    shares = out.balance_by_split.filter("class = '1'").select("split", F.col("fraction").alias("positive_share"))
    curve = out.training.roc().groupBy("model", "split").agg(
        ((F.min("tpr") == 0) & (F.min("fpr") == 0) & (F.max("tpr") == 1) & (F.max("fpr") == 1)).alias("curve_is_whole"))
    scored = out.training.scored.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(TARGET).cast("bigint")).alias("n_positive"))
    facts = scored.join(shares, "split").join(curve, ["model", "split"]).withColumns({
        "n_dropped": F.lit(len(out.dropped)).cast("bigint"), "n_features": F.lit(out.features.count()).cast("bigint")})
    return _released(out, lambda _: rounded(facts))


_IMP = "imp AS (SELECT feature, avg(abs(contribution)) AS m, row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS rank FROM long GROUP BY feature)"


@query("global_importance", ["K4"], f"WITH {_INPUTS}, {_IMP} SELECT CAST(rank AS INTEGER) AS rank, feature, {r('m')} AS mean_abs_shap FROM imp")
def global_importance(spark, folder):
    return rounded(K.global_importance(_linear(spark, folder)))


_TOPS = """tops AS (SELECT id, string_agg(CASE WHEN contribution > 0 AND up <= 2 THEN feature END, ',' ORDER BY up) AS top_positive,
string_agg(CASE WHEN contribution < 0 AND down <= 2 THEN feature END, ',' ORDER BY down) AS top_negative
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -contribution, feature) AS up, row_number() OVER (PARTITION BY id ORDER BY contribution, feature) AS down FROM long) GROUP BY id)"""


@query("local_explanations", ["K5"], f"WITH {_INPUTS}, {_TOPS} SELECT id, {r('b')} AS base_value, coalesce(top_positive, '') AS top_positive, coalesce(top_negative, '') AS top_negative FROM tops, base")
def local_explanations(spark, folder):
    tops = K.top_contributors(_linear(spark, folder), ["id"], 2)
    return rounded(tops.select("id", "base_value", *[F.concat_ws(",", f"{c}.feature").alias(c) for c in ("top_positive", "top_negative")]))


@query("summary_data", ["K6"], f"""WITH {_INPUTS}, {_IMP} SELECT id, CAST(rank AS INTEGER) AS rank, long.feature, {r('value')} AS value, {r('contribution')} AS contribution,
{r('m')} AS mean_abs_shap FROM long JOIN imp ON imp.feature = long.feature WHERE rank <= 2""")
def summary_data(spark, folder):
    return rounded(K.summary_data(_linear(spark, folder), ["id"], 2))


@query("dependence_data", ["K7"], f"""WITH {_INPUTS} SELECT a.id, {r('a.value')} AS feature_value, {r('a.contribution')} AS contribution, {r('b.value')} AS interaction_value
FROM long a JOIN long b ON a.id = b.id WHERE a.feature = 'balance' AND b.feature = 'months'""")
def dependence_data(spark, folder):
    return rounded(K.dependence_data(_linear(spark, folder), ["id"], "balance", list(COEF), "months"))


@query("importance_table", ["K8"], f"WITH {_INPUTS}, {_IMP} SELECT CAST(rank AS INTEGER) AS rank, feature, {r('m')} AS mean_abs_shap FROM imp WHERE rank <= 2")
def importance_table(spark, folder):
    return rounded(K.importance_table(_linear(spark, folder), 2))
