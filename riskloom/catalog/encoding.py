"""Queries on preprocessing and supervised encoders."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import preprocess as D
from ..operators.encode import SmartEncoder, TargetEncoder, WOEEncoder
from ..operators.stages import TargetStage, WOEStage
from ..plans.rows import local_table
from ..session import fresh_path
from .frames import ACCOUNTS, SHIP_CATEGORICAL, SHIP_NUMERIC, SHIPMENTS, accounts, shipments
from .registry import query, rounded, table
from .sql import big, edge_ctes, hash_rank, quantile_cte, r

# -- preprocessing ----------------------------------------------------------------


@query("median_imputation", ["D1"], f"""WITH {ACCOUNTS}, {quantile_cte('mid', 'acc', 'balance', 1, 2)}
SELECT id, {r('coalesce(balance, q)')} AS balance FROM acc, mid""")
def median_imputation(spark, folder):
    return rounded(D.impute(accounts(spark, folder), numeric=["balance"]).select("id", "balance"))


@query("mode_imputation", ["D2"], f"""WITH {ACCOUNTS}, top AS (SELECT segment AS m FROM acc WHERE segment IS NOT NULL
GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) SELECT id, coalesce(segment, m) AS segment FROM acc, top""")
def mode_imputation(spark, folder):
    return D.impute(accounts(spark, folder), categorical=["segment"]).select("id", "segment")


@query("population_standardisation", ["D3"], f"""WITH {ACCOUNTS}, {quantile_cte('mid', 'acc', 'balance', 1, 2)},
filled AS (SELECT id, price, coalesce(balance, q) AS balance FROM acc, mid),
m AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(balance) AS mb, stddev_pop(balance) AS sb FROM filled)
SELECT id, {r('(price - mp) / sp')} AS price, {r('(balance - mb) / sb')} AS balance FROM filled, m""")
def population_standardisation(spark, folder):
    return rounded(D.standardise(accounts(spark, folder), ["price", "balance"]).select("id", "price", "balance"))


@query("one_hot_columns", ["D4"], f"""WITH {ACCOUNTS} SELECT id, {', '.join(
    f"CASE WHEN segment = '{v}' THEN 1 ELSE 0 END AS segment_{v}" for v in ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM acc""")
def one_hot_columns(spark, folder):
    acc = accounts(spark, folder)
    levels = D.levels_of(acc, "segment")
    return D.one_hot(acc, "segment", levels).select("id", *[f"segment_{v}" for v in levels])


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_PARTS = "parts AS (SELECT p_partkey, p_size, p_retailprice, nullif(p_type, 'PROMO') AS kind FROM part)"
_ASSEMBLED = f"""WITH {_PARTS}, m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS d FROM parts),
top AS (SELECT kind AS t FROM parts WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
filled AS (SELECT p_partkey, (p_size - a) / b AS s, (p_retailprice - c) / d AS p, coalesce(kind, t) AS kind FROM parts, m, top)"""
_KINDS = [t for t in TYPES if t != "PROMO"]


def _part_features(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", F.nullif("p_type", F.lit("PROMO")).alias("kind"))
    return parts, D.fit_preprocessor(parts, ["p_size", "p_retailprice"], ["kind"])


@query("assembled_features", ["D5"], _ASSEMBLED + f""" SELECT p_partkey, {r('s')} AS f0, {r('p')} AS f1, {', '.join(
    f"CAST(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END AS DOUBLE) AS f{i + 2}" for i, k in enumerate(_KINDS))} FROM filled""")
def assembled_features(spark, folder):
    parts, model = _part_features(spark, folder)
    out = model.transform(parts).select("p_partkey", vector_to_array("features").alias("f"))
    return rounded(out.select("p_partkey", *[F.col("f")[i].alias(f"f{i}") for i in range(2 + len(_KINDS))]))


@query("feature_names", ["D6"], _ASSEMBLED + f""" SELECT CAST(position AS INTEGER) AS position, name, {r('v')} AS total FROM ({' UNION ALL '.join(
    f"SELECT {i} AS position, '{n}' AS name, sum({e}) AS v FROM filled" for i, (n, e) in enumerate(
        [('num__p_size', 's * s'), ('num__p_retailprice', 'p * p')]
        + [(f'cat__kind_{k}', f"CAST(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END AS DOUBLE)") for k in _KINDS]))})""")
def feature_names(spark, folder):
    parts, model = _part_features(spark, folder)
    names = D.feature_names(model)
    cells = model.transform(parts).select(F.posexplode(vector_to_array("features")).alias("position", "v"))
    sums = cells.groupBy("position").agg(F.sum(F.col("v") * F.col("v")).alias("total"))
    named = local_table(spark, enumerate(names), "position int, name string")
    return rounded(sums.join(F.broadcast(named), "position"))


@query("sentinel_fill", ["D7"], f"WITH {ACCOUNTS} SELECT id, coalesce(segment, '__MISSING__') AS segment, coalesce(customer, '__MISSING__') AS customer FROM acc")
def sentinel_fill(spark, folder):
    return accounts(spark, folder).select("id", *[D.fill_missing(F.col(c)).alias(c) for c in ("segment", "customer")])


# -- weight of evidence -----------------------------------------------------------

_WOE_PARTS = """(ev + 0.5) / ((SELECT sum(y) FROM {src}) + 0.5) AS e, (n - ev + 0.5) / ((SELECT sum(1 - y) FROM {src}) + 0.5) AS o"""


def _woe_sql(src, numeric, categorical):
    """CTE ``woe`` with every bin of every feature."""
    cats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '__MISSING__') AS bin, y FROM {src}" for c in categorical)
    ctes = []
    pieces = []
    if categorical:
        ctes.append(f"cat AS (SELECT feature, 'categorical' AS kind, bin, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper,"
                    f" count(*) AS n, sum(y) AS ev FROM ({cats}) GROUP BY feature, bin)")
        pieces.append("SELECT * FROM cat")
    if numeric:
        ctes.append(edge_ctes("q", src, numeric))
        rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, y FROM {src}" for c in numeric)
        ctes.append(f"""
placed AS (SELECT feature, y, CASE WHEN v IS NULL THEN -1 ELSE (SELECT count(*) FROM q_inner u WHERE u.feature = l.feature AND u.e <= l.v) END AS b
  FROM ({rows}) l),
counted AS (SELECT feature, b, count(*) AS n, sum(y) AS ev FROM placed GROUP BY feature, b),
frame AS (SELECT a.feature, a.j AS b, a.e AS lower, z.e AS upper FROM q_uniq a JOIN q_uniq z ON z.feature = a.feature AND z.j = a.j + 1),
num AS (SELECT f.feature, 'numeric' AS kind, CAST(f.b AS VARCHAR) AS bin, f.lower, f.upper, coalesce(c.n, 0) AS n, coalesce(c.ev, 0) AS ev
  FROM frame f LEFT JOIN counted c ON c.feature = f.feature AND c.b = f.b
  UNION ALL SELECT feature, 'numeric', '__MISSING__', NULL, NULL, n, ev FROM counted WHERE b = -1)""")
        pieces.append("SELECT * FROM num")
    ctes.append(f"bins AS ({' UNION ALL '.join(pieces)})")
    ctes.append(f"woe AS (SELECT *, ln(e / o) AS woe, (e - o) * ln(e / o) AS iv FROM (SELECT *, {_WOE_PARTS.format(src=src)} FROM bins))")
    return ", ".join(ctes)


_WOE_OUT = f"""feature, kind, bin, {r('lower')} AS lower, {r('upper')} AS upper, {big('n')} AS count, {big('ev')} AS events, {big('n - ev')} AS non_events,
{r('ev / CAST(greatest(n, 1) AS DOUBLE)')} AS event_rate, {r('woe')} AS woe, {r('iv')} AS iv"""


def _fit_shipments(spark, folder, features):
    return WOEEncoder(persist_input=True).fit(shipments(spark, folder), features, "y")


@query("woe_routing", ["E0"], f"""WITH {SHIPMENTS} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) < 10 OR {str(c in ('priority', 'type', 'brand')).lower()} THEN 'categorical' ELSE 'numeric' END AS kind FROM ship"
    for c in SHIP_NUMERIC + SHIP_CATEGORICAL)}""")
def woe_routing(spark, folder):
    kinds = WOEEncoder().route(shipments(spark, folder), SHIP_NUMERIC + SHIP_CATEGORICAL)
    return local_table(spark, kinds.items(), "feature string, kind string")


@query("woe_fit_categorical", ["E1"], f"WITH {SHIPMENTS}, {_woe_sql('ship', [], SHIP_CATEGORICAL)} SELECT {_WOE_OUT} FROM woe")
def woe_fit_categorical(spark, folder):
    return rounded(_fit_shipments(spark, folder, SHIP_CATEGORICAL).bins)


@query("woe_fit_numeric", ["E2", "E3"], f"WITH {SHIPMENTS}, {_woe_sql('ship', SHIP_NUMERIC, [])} SELECT {_WOE_OUT} FROM woe")
def woe_fit_numeric(spark, folder):
    return rounded(_fit_shipments(spark, folder, SHIP_NUMERIC).bins)


@query("woe_missing_bin", ["E3"], f"""WITH {SHIPMENTS}, {_woe_sql('ship', ['quantity', 'price'], ['priority'])}
SELECT {_WOE_OUT} FROM woe WHERE bin = '__MISSING__'""")
def woe_missing_bin(spark, folder):
    return rounded(_fit_shipments(spark, folder, ["quantity", "price", "priority"]).bins.filter(F.col("bin") == D.MISSING))


_SPAN = "fit AS (SELECT * FROM acc WHERE day < DATE '1999-01-01'), rest AS (SELECT * FROM acc WHERE day >= DATE '1999-01-01')"


def _two_spans(spark, folder):
    acc = accounts(spark, folder)
    early = F.col("day") < F.lit("1999-01-01").cast("date")
    return acc.filter(early), acc.filter(~early)


def _by_category(col):
    key = f"coalesce(CAST({col} AS VARCHAR), '__MISSING__')"
    return f"LEFT JOIN woe w_{col} ON w_{col}.feature = '{col}' AND w_{col}.bin = {key}"


@query("woe_transform_categorical", ["E4"], f"""WITH {ACCOUNTS}, {_SPAN}, {_woe_sql('fit', [], ['segment', 'priority', 'customer'])}
SELECT id, {', '.join(f"{r(f'coalesce(w_{c}.woe, 0)')} AS {c}_woe" for c in ('segment', 'priority', 'customer'))}
FROM rest {' '.join(_by_category(c) for c in ('segment', 'priority', 'customer'))}""")
def woe_transform_categorical(spark, folder):
    fit, rest = _two_spans(spark, folder)
    cols = ["segment", "priority", "customer"]
    model = WOEEncoder().fit(fit, cols, "y")
    return rounded(model.transform(rest).select("id", *[f"{c}_woe" for c in cols]))


def _by_bin(col):
    return (f"LEFT JOIN woe w_{col} ON w_{col}.feature = '{col}' AND w_{col}.bin = CASE WHEN {col} IS NULL THEN '__MISSING__' "
            f"ELSE CAST((SELECT count(*) FROM q_inner u WHERE u.feature = '{col}' AND u.e <= rest.{col}) AS VARCHAR) END")


@query("woe_transform_numeric", ["E5"], f"""WITH {ACCOUNTS}, {_SPAN}, {_woe_sql('fit', ['price', 'balance'], [])}
SELECT id, {', '.join(f"{r(f'coalesce(w_{c}.woe, 0)')} AS {c}_woe" for c in ('price', 'balance'))}
FROM rest {' '.join(_by_bin(c) for c in ('price', 'balance'))}""")
def woe_transform_numeric(spark, folder):
    fit, rest = _two_spans(spark, folder)
    model = WOEEncoder().fit(fit, ["price", "balance"], "y")
    return rounded(model.transform(rest).select("id", "price_woe", "balance_woe"))


_SAVED = ["segment", "priority", "customer", "price", "balance"]


@query("saved_encoders", ["E4", "E5", "E10", "A4", "A5"], f"""WITH {ACCOUNTS}, {_SPAN}, {_woe_sql('fit', ['price', 'balance'], ['segment', 'priority', 'customer'])},
g AS (SELECT avg(y) AS m FROM fit), te AS (SELECT customer, (sum(y) + any_value(m)) / (count(*) + 1.0) AS encoding FROM fit, g WHERE customer IS NOT NULL GROUP BY customer)
SELECT id, {', '.join(f"{r(f'coalesce(w_{c}.woe, 0)')} AS {c}_woe" for c in _SAVED)}, {r('coalesce(te.encoding, m)')} AS customer_te
FROM rest CROSS JOIN g {' '.join(_by_category(c) for c in _SAVED[:3])} {' '.join(_by_bin(c) for c in _SAVED[3:])} LEFT JOIN te ON te.customer = rest.customer""")
def saved_encoders(spark, folder):
    """Encoders fitted as stages of a pipeline, saved, loaded and applied to rows that the fit has not seen."""
    fit, rest = _two_spans(spark, folder)
    stages = [WOEStage(inputCols=_SAVED, labelCol="y"), TargetStage(inputCols=["customer"], labelCol="y")]
    path = fresh_path(spark, "encoders")
    Pipeline(stages=stages).fit(fit).write().save(path)
    out = PipelineModel.load(path).transform(rest)
    return rounded(out.select("id", *[f"{c}_woe" for c in _SAVED], "customer_te"))


IV_SQL = f"""WITH {SHIPMENTS}, {_woe_sql('ship', SHIP_NUMERIC, SHIP_CATEGORICAL)}, s AS (SELECT feature, sum(iv) AS iv FROM woe GROUP BY feature)
SELECT feature, {r('iv')} AS iv, CASE WHEN iv < 0.02 THEN 'useless' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium'
WHEN iv < 0.5 THEN 'strong' ELSE 'suspicious' END AS strength FROM s"""


@query("information_value", ["E6", "E7"], IV_SQL)
def information_value(spark, folder):
    """Which attributes best separate returned line items?"""
    return rounded(_fit_shipments(spark, folder, SHIP_NUMERIC + SHIP_CATEGORICAL).iv())


@query("woe_report", ["E8"], f"WITH {SHIPMENTS}, {_woe_sql('ship', ['price'], ['brand'])} SELECT {_WOE_OUT} FROM woe WHERE feature = 'price'")
def woe_report(spark, folder):
    return rounded(_fit_shipments(spark, folder, ["price", "brand"]).report("price"))


# -- target encoding --------------------------------------------------------------

_TE_FIT = """g AS (SELECT avg(y) AS m FROM {src}),
te AS (SELECT feature, category, count(*) AS n, (sum(y) + any_value(m)) / (count(*) + 1.0) AS encoding FROM
  (SELECT 'customer' AS feature, customer AS category, y FROM {src} UNION ALL SELECT 'segment', segment, y FROM {src}), g
  WHERE category IS NOT NULL GROUP BY feature, category)"""


@query("target_encoding_fit", ["E9"], f"WITH {ACCOUNTS}, {_TE_FIT.format(src='acc')} SELECT feature, category, {big('n')} AS n, {r('encoding')} AS encoding FROM te")
def target_encoding_fit(spark, folder):
    return rounded(TargetEncoder().fit(accounts(spark, folder), ["customer", "segment"], "y").table)


@query("target_encoding_transform", ["E10"], f"""WITH {ACCOUNTS}, {_SPAN}, {_TE_FIT.format(src='fit')}
SELECT id, {r('coalesce(a.encoding, m)')} AS customer_te, {r('coalesce(b.encoding, m)')} AS segment_te FROM rest CROSS JOIN g
LEFT JOIN te a ON a.feature = 'customer' AND a.category = customer LEFT JOIN te b ON b.feature = 'segment' AND b.category = segment""")
def target_encoding_transform(spark, folder):
    fit, rest = _two_spans(spark, folder)
    model = TargetEncoder().fit(fit, ["customer", "segment"], "y")
    return rounded(model.transform(rest).select("id", "customer_te", "segment_te"))


_OOF = f"""ranked AS (SELECT *, {hash_rank('id', 42, None)} AS rk, count(*) OVER () AS n FROM acc),
f AS (SELECT *, CASE WHEN rk < n * 1 // 5 THEN 0 WHEN rk < n * 2 // 5 THEN 1 WHEN rk < n * 3 // 5 THEN 2 WHEN rk < n * 4 // 5 THEN 3 ELSE 4 END AS fold FROM ranked),
g AS (SELECT avg(y) AS m FROM acc)"""


@query("target_encoding_out_of_fold", ["E11"], f"""WITH {ACCOUNTS}, {_OOF},
folds AS (SELECT customer, fold, sum(y) AS s, count(*) AS n FROM f GROUP BY customer, fold),
others AS (SELECT a.customer, a.fold, sum(b.s) AS s, sum(b.n) AS n FROM folds a JOIN folds b ON a.customer = b.customer AND a.fold <> b.fold GROUP BY 1, 2)
SELECT id, CAST(f.fold AS INTEGER) AS fold, {r('CASE WHEN o.n > 0 THEN (o.s + m) / (o.n + 1.0) ELSE m END')} AS customer_te
FROM f CROSS JOIN g LEFT JOIN others o ON o.customer = f.customer AND o.fold = f.fold""")
def target_encoding_out_of_fold(spark, folder):
    from ..operators.target import folds

    acc = folds(accounts(spark, folder), ["id"], 5, 42)
    out = TargetEncoder().fit_transform(acc, ["customer"], "y", ["id"], fold="fold")
    return rounded(out.select("id", "fold", "customer_te"))


CHOICES = ["segment", "priority", "nation", "customer", "price"]


@query("encoder_choice", ["E12"], f"""WITH {ACCOUNTS} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) <= 5 THEN 'onehot' WHEN count(DISTINCT {c}) <= 50 THEN 'woe' ELSE 'target' END AS strategy FROM acc"
    for c in CHOICES)}""")
def encoder_choice(spark, folder):
    return local_table(spark, SmartEncoder().choose(accounts(spark, folder), CHOICES).items(), "feature string, strategy string")


@query("smart_encoding", ["E13"], f"""WITH {ACCOUNTS}, {_woe_sql('acc', [], ['nation'])}, {_TE_FIT.format(src='acc')}
SELECT id, {', '.join(f"CASE WHEN segment = '{v}' THEN 1 ELSE 0 END AS segment_{v}" for v in ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))},
CASE WHEN segment IS NULL THEN 1 ELSE 0 END AS segment_null, {r('w_nation.woe')} AS nation, {r('coalesce(t.encoding, m)')} AS customer
FROM acc CROSS JOIN g {_by_category('nation')} LEFT JOIN te t ON t.feature = 'customer' AND t.category = customer""")
def smart_encoding(spark, folder):
    acc = accounts(spark, folder)
    cols = ["segment", "nation", "customer"]
    out = SmartEncoder().fit(acc, cols, "y").transform(acc.select("id", *cols))
    return rounded(out)
