"""Queries on derived features. Table columns stand in for the credit, retail and stock inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..functions import derive as X
from ..operators import timeframe as W
from .frames import ACCOUNTS, SUPPLIER_MONTHS, accounts, null_if, supplier_months
from .registry import query, rounded, table
from .sql import edge_ctes, quantile_cte, r


def _orders(spark, folder):
    return table(spark, folder, "orders")


def _customers(spark, folder):
    return table(spark, folder, "customer")


def _lines(spark, folder):
    """Line items with their full key, which only all five columns give."""
    return table(spark, folder, "lineitem")


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
_LK = ", ".join(LINE_KEY)


@query("bounded_ratios", ["F1"], f"""SELECT {_LK},
{r('least(greatest(l_quantity / 50, 0), 1)', 9)} AS utilisation, {r('least(greatest(l_extendedprice / greatest(l_quantity * 437, 1), 0), 5)', 9)} AS dti,
{r('least(greatest((l_linenumber * CAST(1000 AS DOUBLE) + l_quantity * CAST(0.3 AS DOUBLE)) / greatest(l_extendedprice, 1), 0), 1)', 9)} AS secured_share,
{r('least(greatest(l_quantity / greatest(coalesce(nullif(l_tax, CAST(0.02 AS DOUBLE)) * 10, 1), 1), 0), 10)', 9)} AS liquidity FROM lineitem""")
def bounded_ratios(spark, folder):
    return rounded(_lines(spark, folder).select(
        *LINE_KEY,
        X.bounded_ratio("l_quantity", F.lit(50)).alias("utilisation"),
        X.bounded_ratio("l_extendedprice", F.col("l_quantity") * 437, 0, 5).alias("dti"),
        X.secured_share(F.col("l_linenumber") * 1000.0, "l_quantity", "l_extendedprice").alias("secured_share"),
        X.bounded_ratio("l_quantity", F.coalesce(null_if("l_tax", 0.02) * 10, F.lit(1.0)), 0, 10).alias("liquidity")), 9)


@query("sums_and_differences", ["F2"], f"""SELECT {_LK}, {r('l_quantity + l_discount + l_tax')} AS total_debt,
{r('greatest(l_quantity - 20, 0)')} AS available_credit, {r('l_discount - l_tax')} AS net_worth, {r('l_extendedprice / 12')} AS monthly_income FROM lineitem""")
def sums_and_differences(spark, folder):
    return rounded(_lines(spark, folder).select(
        *LINE_KEY, X.total("l_quantity", "l_discount", "l_tax").alias("total_debt"),
        X.available_credit("l_quantity", F.lit(20.0)).alias("available_credit"),
        X.net_worth("l_discount", "l_tax").alias("net_worth"), X.monthly("l_extendedprice").alias("monthly_income")))


_BAL = quantile_cte("mid", "acc", "balance", 1, 2)


@query("log_and_root", ["F3", "F4"], f"WITH {ACCOUNTS}, {_BAL} SELECT id, {r('ln(1 + abs(coalesce(balance, q)))')} AS balance_log, {r('sqrt(abs(coalesce(balance, q)))')} AS balance_sqrt FROM acc, mid")
def log_and_root(spark, folder):
    out = W.scaled_features(accounts(spark, folder).select("id", "balance"), ["balance"])
    return rounded(out.select("id", "balance_log", "balance_sqrt"))


@query("z_scores", ["F5"], f"""WITH {ACCOUNTS}, {_BAL}, f AS (SELECT id, coalesce(balance, q) AS b FROM acc, mid)
SELECT id, {r('(b - (SELECT avg(b) FROM f)) / ((SELECT stddev_pop(b) FROM f) + 1e-8)')} AS balance_zscore FROM f""")
def z_scores(spark, folder):
    out = W.scaled_features(accounts(spark, folder).select("id", "balance"), ["balance"])
    return rounded(out.select("id", "balance_zscore"))


@query("percentile_position", ["F6"], f"""SELECT o_orderkey,
{r('(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / CAST(count(*) OVER () AS DOUBLE)')} AS price_pctl FROM orders""")
def percentile_position(spark, folder):
    out = W.percentile_position(_orders(spark, folder).select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "price_pctl")
    return rounded(out.select("o_orderkey", "price_pctl"))


@query("percentile_position_of_ties", ["F6"], f"""SELECT event_id,
{r('(row_number() OVER (ORDER BY floor(value / 50), event_id) - 1) / CAST(count(*) OVER () AS DOUBLE)')} AS value_pctl FROM events""")
def percentile_position_of_ties(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.floor(F.col("value") / 50).alias("level"))
    # a small bucket size makes this run the path that large tables take
    return rounded(W.percentile_position(e, "level", "event_id", "value_pctl", rows_per_bucket=500).select("event_id", "value_pctl"))


@query("quantile_decile", ["F7"], f"""WITH {edge_ctes('q', 'lineitem', ['l_quantity'])}
SELECT {_LK}, CAST((SELECT count(*) FROM q_inner u WHERE u.e < l_quantity) AS INTEGER) AS quantity_decile FROM lineitem""")
def quantile_decile(spark, folder):
    return W.quantile_bins(_lines(spark, folder), "l_quantity", "quantity_decile").select(*LINE_KEY, "quantity_decile")


def _over(k_from, k_to, order="period"):
    return f"(PARTITION BY supplier ORDER BY {order} ROWS BETWEEN {k_from} PRECEDING AND {k_to})"


def _roll(k):
    w = _over(k - 1, "CURRENT ROW")
    return ", ".join(f"{r(f'{f}(units) OVER {w}')} AS units_{n}_{k}" for n, f in
                     (("avg", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop")))


@query("rolling_statistics", ["F8"], f"WITH {SUPPLIER_MONTHS} SELECT supplier, period, units, {_roll(3)}, {_roll(6)}, {_roll(12)} FROM months")
def rolling_statistics(spark, folder):
    return rounded(W.rolling(supplier_months(spark, folder), ["supplier"], "period", "units"))


PAIRS = [("l_extendedprice", "l_quantity"), ("l_discount", "tax")]


def _pair(a, b):
    y = f"coalesce({b}, 0)"
    return ", ".join(f"{r(e, 7)} AS {a}_{n}_{b}" for n, e in (
        ("x", f"{a} * {y}"), ("div", f"{a} / greatest({y}, 1e-8)"), ("plus", f"{a} + {y}"), ("minus", f"{a} - {y}"),
        ("max", f"greatest({a}, {y})"), ("min", f"least({a}, {y})")))


@query("pair_interactions", ["F9"], f"""WITH l AS (SELECT *, nullif(l_tax, CAST(0.04 AS DOUBLE)) AS tax FROM lineitem)
SELECT {_LK}, {', '.join(_pair(a, b) for a, b in PAIRS)} FROM l""")
def pair_interactions(spark, folder):
    li = _lines(spark, folder).withColumn("tax", null_if("l_tax", 0.04))
    return rounded(li.select(*LINE_KEY, *[c.alias(n) for n, c in X.pair_interactions(PAIRS).items()]), 7)


@query("risk_triple", ["F10"], f"""WITH l AS (SELECT {_LK}, coalesce(nullif(l_tax, CAST(0.04 AS DOUBLE)), 0.3) AS u, coalesce(l_discount * 3, 0.3) AS d,
(850 - coalesce(CASE WHEN l_quantity > 5 THEN 300 + l_quantity * 11 END, 680)) / CAST(850 AS DOUBLE) AS g FROM lineitem)
SELECT {_LK}, {r('u * d * g')} AS risk_triple_product, {r('u * 0.3 + d * 0.3 + g * 0.4')} AS risk_weighted_sum FROM l""")
def risk_triple(spark, folder):
    parts = X.risk_triple(null_if("l_tax", 0.04), F.col("l_discount") * 3, F.when(F.col("l_quantity") > 5, 300 + F.col("l_quantity") * 11))
    return rounded(_lines(spark, folder).select(*LINE_KEY, *[c.alias(n) for n, c in parts.items()]))


@query("powers", ["F11"], f"SELECT {_LK}, {r('coalesce(nullif(l_quantity, 3), 0) ** 2')} AS quantity_squared, {r('coalesce(nullif(l_quantity, 3), 0) ** 3')} AS quantity_cubed FROM lineitem")
def powers(spark, folder):
    parts = X.powers(null_if("l_quantity", 3.0), "quantity")
    return rounded(_lines(spark, folder).select(*LINE_KEY, *[c.alias(n) for n, c in parts.items()]))


def _lag(k):
    b = f"lag(units, {k}) OVER (PARTITION BY supplier ORDER BY period)"
    return f"{r(b)} AS units_lag_{k}, {r(f'units - {b}')} AS units_chg_{k}, {r(f'(units - {b}) / nullif({b}, 0)')} AS units_pct_chg_{k}"


@query("lagged_values", ["F12"], f"WITH {SUPPLIER_MONTHS} SELECT supplier, period, units, {', '.join(_lag(k) for k in (1, 3, 6, 12))} FROM months")
def lagged_values(spark, folder):
    return rounded(W.lags(supplier_months(spark, folder), ["supplier"], "period", "units"))


@query("lagged_values_of_hot_entity", ["F12", "F8"], f"""SELECT event_id, grp, {r('lag(value, 3) OVER w')} AS value_lag_3,
{r('avg(value) OVER (PARTITION BY grp ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS value_avg_6
FROM (SELECT event_id, value, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS grp FROM events)
WINDOW w AS (PARTITION BY grp ORDER BY event_id)""")
def lagged_values_of_hot_entity(spark, folder):
    """A third of the rows share one key: its rows are cut into blocks with a few rows of overlap."""
    e = table(spark, folder, "events").select("event_id", "value", F.when(
        F.col("user_id") % 3 == 0, "hot").otherwise(F.col("user_id").cast("string")).alias("grp"))

    def make(w):
        return {"value_lag_3": F.lag("value", 3).over(w), "value_avg_6": F.avg("value").over(w.rowsBetween(-5, 0))}

    return rounded(W.with_frames(e, ["grp"], "event_id", make, 6, rows_per_block=400).drop("value"))


@query("lags_deeper_than_blocks", ["F12", "F22"], f"""SELECT event_id, {r('lag(value, 12) OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id)')} AS value_lag_12,
{r('avg(value) OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)')} AS value_before_30 FROM events""")
def lags_deeper_than_blocks(spark, folder):
    """Frames that look back over several blocks of large entities; rows of one time come in id order."""
    e = table(spark, folder, "events").select("event_id", "ts", "value", (F.col("user_id") % 2).alias("grp"))

    def make(w):
        return {"value_lag_12": F.lag("value", 12).over(w), "value_before_30": F.avg("value").over(w.rowsBetween(-30, -1))}

    out = W.with_frames(e, ["grp"], "ts", make, 30, rows_per_block=11, tiebreak="event_id")
    return rounded(out.select("event_id", "value_lag_12", "value_before_30"))


@query("trend_and_momentum", ["F13"], f"""WITH {SUPPLIER_MONTHS}, m AS (SELECT *, year(period) * 12 + month(period) AS idx FROM months)
SELECT supplier, period, units, {', '.join(f"CAST(sign(units - avg(units) OVER {_over(k, '1 PRECEDING')}) AS INTEGER) AS units_trend_{k}" for k in (3, 6))},
{r(f"regr_slope(units, idx) OVER {_over(5, 'CURRENT ROW')}", 4)} AS units_momentum FROM m""")
def trend_and_momentum(spark, folder):
    m = supplier_months(spark, folder).withColumn("idx", F.year("period") * 12 + F.month("period"))
    out = W.trends(m, ["supplier"], "period", "units", "idx").drop("idx")
    return out.withColumn("units_momentum", F.round("units_momentum", 4))


@query("score_bands", ["F14"], "SELECT o_orderkey, CASE WHEN s < 580 THEN 'poor' WHEN s < 670 THEN 'fair' WHEN s < 740 THEN 'good' WHEN s < 800 THEN 'very_good' ELSE 'excellent' END AS score_band FROM (SELECT o_orderkey, 300 + o_orderkey % 551 AS s FROM orders)")
def score_bands(spark, folder):
    return _orders(spark, folder).select("o_orderkey", bands.score_band(F.lit(300) + F.col("o_orderkey") % 551).alias("score_band"))


_PERCUST = """per AS (SELECT o_custkey AS customer, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS a,
sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS c,
count(*) AS n, avg(o_totalprice) AS avg_price, max(o_totalprice) AS max_price, date_diff('month', min(o_orderdate), max(o_orderdate)) AS raw_months,
datediff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS days FROM orders GROUP BY 1)"""


def per_customer(spark, folder):
    o = _orders(spark, folder)
    of = lambda p: F.count_if(F.col("o_orderpriority") == p)
    day = F.col("o_orderdate").cast("date")
    return o.groupBy(F.col("o_custkey").alias("customer")).agg(
        of("1-URGENT").alias("a"), of("2-HIGH").alias("b"), of("3-MEDIUM").alias("c"), F.count(F.lit(1)).alias("n"),
        F.avg("o_totalprice").alias("avg_price"), F.max("o_totalprice").alias("max_price"),
        F.datediff(F.max(day), F.min(day)).alias("days"))


@query("delinquency_intensity", ["F15"], f"WITH {_PERCUST} SELECT customer, CAST(a + 2 * b + 4 * c AS BIGINT) AS intensity FROM per")
def delinquency_intensity(spark, folder):
    return per_customer(spark, folder).select("customer", X.delinquency_intensity("a", "b", "c").alias("intensity"))


@query("composite_score", ["F16"], f"""WITH {_PERCUST} SELECT customer,
{r('(300 + n * 10) * 0.4 + (100 - a) * 6 * 0.3 + (1 - avg_price / max_price) * 850 * 0.3')} AS composite FROM per""")
def composite_score(spark, folder):
    out = per_customer(spark, folder).select("customer", X.composite_score(
        F.lit(300) + F.col("n") * 10, F.lit(100) - F.col("a"), F.col("avg_price") / F.col("max_price")).alias("composite"))
    return rounded(out)


@query("velocity_and_age", ["F17"], f"""WITH {_PERCUST} SELECT customer, {r('n / greatest((days / 30.0) / 12.0, 1)')} AS velocity,
{r('least(greatest((days / CAST(30 AS DOUBLE)) / 12, 0), 30)')} AS credit_age, {r('least(greatest(n / CAST(6 AS DOUBLE), 0), 3)')} AS inquiry_intensity,
{r('least(greatest(1 - (a * 2 + b) / CAST(24 AS DOUBLE), 0.5), 1)')} AS on_time_rate FROM per""")
def velocity_and_age(spark, folder):
    months = F.col("days") / 30.0
    out = per_customer(spark, folder).select(
        "customer", X.account_velocity("n", months).alias("velocity"), X.credit_age(months).alias("credit_age"),
        X.inquiry_intensity("n").alias("inquiry_intensity"), X.on_time_rate("a", "b").alias("on_time_rate"))
    return rounded(out)


@query("amounts_with_sentinel", ["F18"], f"""WITH {_PERCUST} SELECT customer, {r('CASE WHEN a > 0 THEN max_price ELSE 0 END')} AS urgent_amount,
CAST(CASE WHEN b > 0 THEN days ELSE 999 END AS INTEGER) AS days_since FROM per""")
def amounts_with_sentinel(spark, folder):
    out = per_customer(spark, folder).select(
        "customer", X.amount_if_any("a", "max_price", 0.0).alias("urgent_amount"), X.amount_if_any("b", "days", 999).alias("days_since"))
    return rounded(out)


_CARD = f"""{_PERCUST}, z AS (SELECT customer, -((300 + n * 20) - 600) / CAST(50 AS DOUBLE) + u * 2 + CASE WHEN u > 0.8 THEN 1.5 ELSE 0 END + n / CAST(20 AS DOUBLE) * 0.8
+ a * 0.6 + c * 1.2 - ((100 - b) - 50) / CAST(25 AS DOUBLE) - ln(1 + coalesce(inc, 50000)) / 5 - ln(1 + n) / 4 AS log_odds
FROM (SELECT *, avg_price / max_price AS u, CASE WHEN a > 0 THEN avg_price END AS inc FROM per))"""


# The published weights of the default scorecard.
DEFAULT_CARD = [
    X.ScorecardLine("score", fill=680, weight=-1 / 50, offset=600),
    X.ScorecardLine("util", fill=0.3, weight=2, limit=0.8, jump=1.5),
    X.ScorecardLine("dti", fill=0.3, weight=0.8),
    X.ScorecardLine("a", fill=0, weight=0.6),
    X.ScorecardLine("c", fill=0, weight=1.2),
    X.ScorecardLine("payment", fill=80, weight=-1 / 25, offset=50),
    X.ScorecardLine("income", fill=50_000, weight=-1 / 5, log=True),
    X.ScorecardLine("n", fill=24, weight=-1 / 4, log=True),
]
# The published calendar of the shop tables.
SHOP_CALENDAR = X.CalendarRules(
    holiday_months=(10, 11), holiday_days=(25,), new_year_days=3, festival_months=(4, 10), term=(6, 11), payday_weeks=(0, 1),
    seasons={"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)})


@query("scorecard_target", ["F19"], f"""WITH {_CARD}, p AS (SELECT customer, log_odds, 1 / (1 + exp(-log_odds)) AS probability FROM z),
{quantile_cte('cut', 'p', 'probability', 17, 20)}
SELECT customer, {r('log_odds')} AS log_odds, {r('probability')} AS probability, CASE WHEN probability > q THEN 1 ELSE 0 END AS flag FROM p, cut""")
def scorecard_target(spark, folder):
    from ..operators.target import top_quantile_flag

    c = per_customer(spark, folder).withColumns({
        "score": F.lit(300) + F.col("n") * 20, "util": F.col("avg_price") / F.col("max_price"), "dti": F.col("n") / 20,
        "payment": F.lit(100) - F.col("b"), "income": F.when(F.col("a") > 0, F.col("avg_price"))})
    scored = c.select("customer", X.scorecard(DEFAULT_CARD).alias("log_odds"))
    scored = scored.withColumn("probability", X.sigmoid("log_odds"))
    return rounded(top_quantile_flag(scored, "probability", 0.15))


@query("calendar_parts", ["F20"], """SELECT o_orderkey, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(month(d) AS INTEGER) AS month,
CAST(quarter(d) AS INTEGER) AS quarter, CAST(weekofyear(d) AS INTEGER) AS week_of_year, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
CASE WHEN hol THEN 1 ELSE 0 END AS is_holiday, CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring' WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
CASE WHEN weekofyear(d) % 4 IN (0, 1) THEN 1 ELSE 0 END AS payday_week, CASE WHEN hol OR month(d) IN (4, 10) THEN 1 ELSE 0 END AS festival_period,
CASE WHEN month(d) BETWEEN 6 AND 11 THEN 1 ELSE 0 END AS school_term, CAST(date_diff('day', DATE '1995-01-01', d) AS INTEGER) AS days_since_start
FROM (SELECT o_orderkey, d, month(d) IN (10, 11) OR (month(d) = 1 AND day(d) <= 3) OR day(d) = 25 AS hol FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))""")
def calendar_parts(spark, folder):
    return _orders(spark, folder).select("o_orderkey", *[c.alias(n) for n, c in X.calendar_parts("o_orderdate", "1995-01-01", SHOP_CALENDAR).items()])


_SPINE = f"""{SUPPLIER_MONTHS}, spine AS (SELECT s_suppkey AS supplier, s_nationkey, CAST(unnest(range(lo, hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS period
FROM supplier, (SELECT min(period) AS lo, max(period) AS hi FROM months)),
laid AS (SELECT s.supplier, s.s_nationkey, s.period, coalesce(m.units, 0) AS units FROM spine s LEFT JOIN months m ON m.supplier = s.supplier AND m.period = s.period)"""


def _laid(spark, folder):
    sup = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    months = supplier_months(spark, folder)
    spine = W.entity_spine(sup, *W.period_bounds(months, "period"))
    return W.on_spine(spine, months, ["supplier", "period"])


@query("entity_period_spine", ["F21"], f"WITH {_SPINE} SELECT supplier, s_nationkey, period, {r('units')} AS units FROM laid")
def entity_period_spine(spark, folder):
    return rounded(_laid(spark, folder))


def _trail(k):
    return f"{r(f'coalesce(avg(units) OVER {_over(k, _BEFORE)}, units)')} AS units_trail_{k}"


_BEFORE = "1 PRECEDING"


@query("trailing_means", ["F22"], f"WITH {_SPINE} SELECT supplier, period, {_trail(4)}, {_trail(12)} FROM laid")
def trailing_means(spark, folder):
    return rounded(W.trailing_means(_laid(spark, folder), ["supplier"], "period", "units").drop("s_nationkey", "units"))


@query("trailing_variation", ["F23"], f"""WITH {_SPINE} SELECT supplier, period,
{r(f"coalesce(stddev_pop(units) OVER {_over(8, '1 PRECEDING')} / (avg(units) OVER {_over(8, '1 PRECEDING')} + 1e-6), 0.1)", 3)} AS units_cv FROM laid""")
def trailing_variation(spark, folder):
    return W.trailing_variation(_laid(spark, folder), ["supplier"], "period", "units").drop("s_nationkey", "units")


_STOCK = """stock AS (SELECT p_partkey, sum(l_quantity) AS demand, p_size AS lead, p_retailprice AS price, (p_size % 10) / CAST(10 AS DOUBLE) AS storage, p_size * 40 AS held
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
a AS (SELECT *, round(demand * (lead / CAST(7 AS DOUBLE)) * 1.1, 0) AS safety FROM stock),
b AS (SELECT *, round(safety + demand * (lead / CAST(7 AS DOUBLE)), 0) AS rop FROM a)"""


def _stock(spark, folder):
    p, li = table(spark, folder, "part"), table(spark, folder, "lineitem")
    demand = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("demand"))
    s = p.join(demand, p.p_partkey == demand.l_partkey).select(
        "p_partkey", "demand", F.col("p_size").alias("lead"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") % 10 / 10.0).alias("storage"), (F.col("p_size") * 40).alias("held"))
    s = s.withColumn("safety", X.safety_stock("demand", "lead", 1.1))
    return s.withColumn("rop", X.reorder_point("safety", "demand", "lead"))


@query("stock_levels", ["F24"], f"WITH {_STOCK} SELECT p_partkey, {r('safety')} AS safety, {r('rop')} AS rop, {r('round(sqrt(demand * 2 * 52 * price * 0.03 / (storage + 0.01)) + 1, 0)')} AS eoq FROM b")
def stock_levels(spark, folder):
    s = _stock(spark, folder).withColumn("eoq", X.order_quantity("demand", "price", "storage"))
    return rounded(s.select("p_partkey", "safety", "rop", "eoq"))


@query("stock_cover", ["F25"], f"WITH {_STOCK} SELECT p_partkey, {r('least(greatest(round(held / (demand / 7 + 0.1), 1), 0), 365)')} AS days_of_cover, {r('greatest(held - rop * 2, 0)')} AS overstock FROM b")
def stock_cover(spark, folder):
    s = _stock(spark, folder)
    return rounded(s.select("p_partkey", X.days_of_cover("held", "demand").alias("days_of_cover"), X.overstock("held", "rop").alias("overstock")))


@query("demand_trend", ["F26"], f"""WITH {_SPINE}, t AS (SELECT supplier, period, units, coalesce(avg(units) OVER {_over(12, '1 PRECEDING')}, units) AS m FROM laid)
SELECT supplier, period, CASE WHEN units - m > m * 0.1 THEN 'increasing' WHEN units - m < -m * 0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM t""")
def demand_trend(spark, folder):
    t = W.trailing_means(_laid(spark, folder), ["supplier"], "period", "units", (12,))
    return t.select("supplier", "period", X.trend_label("units", "units_trail_12").alias("trend"))


@query("basket_arithmetic", ["F27"], f"""WITH b AS (SELECT l_orderkey, sum(l_quantity) AS amount, count(*) AS items, count(*) * 5 AS disc,
{', '.join(f"sum(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS n_{t.lower()}" for t in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))}
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, {r('amount / items', 2)} AS avg_item_price, {r('amount - amount * disc / 100', 2)} AS net_amount, {r('amount * CAST(0.18 AS DOUBLE)', 2)} AS tax_amount,
CAST(least(greatest({' + '.join(f"CASE WHEN n_{t} > 0 THEN 1 ELSE 0 END" for t in ('economy', 'large', 'medium', 'promo', 'small', 'standard'))}, 1), 5) AS INTEGER) AS categories,
{r("least(greatest(round(n_promo / items * 100, 1), 0), 100)")} AS promo_pct FROM b""")
def basket_arithmetic(spark, folder):
    li, p = table(spark, folder, "lineitem"), table(spark, folder, "part")
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    b = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("amount"), F.count(F.lit(1)).alias("items"), (F.count(F.lit(1)) * 5).alias("disc"),
        *[F.count_if(F.col("p_type") == k).alias(f"n_{k.lower()}") for k in kinds])
    parts = X.basket("amount", "items", "disc")
    return b.select(
        "l_orderkey", *[c.alias(n) for n, c in parts.items()],
        X.categories_present([f"n_{k.lower()}" for k in kinds]).alias("categories"),
        X.share_pct("n_promo", "items").alias("promo_pct"))


@query("weighted_risk_target", ["F28"], f"""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders),
z AS (SELECT o_orderkey, 0.35 * ((o_totalprice - a) / (s + 1e-8)) + 0.15 * CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END
- 0.04 * CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS risk_score FROM orders, m)
SELECT o_orderkey, {r('risk_score')} AS risk_score, CASE WHEN 1 / (1 + exp(-least(greatest(risk_score, -15), 15))) > 0.5 THEN 1 ELSE 0 END AS risk_flag FROM z""")
def weighted_risk_target(spark, folder):
    o = W.z_scores(_orders(spark, folder), ["o_totalprice"], "_z")
    is_ = lambda c: c.cast("int").cast("double")
    parts = X.weighted_risk([(0.35, F.col("o_totalprice_z")), (0.15, is_(F.col("o_orderpriority") == "1-URGENT")),
                             (-0.04, is_(F.col("o_orderstatus") == "P"))])
    return rounded(o.select("o_orderkey", *[c.alias(n) for n, c in parts.items()]))
