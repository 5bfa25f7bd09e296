"""Queries on sources, profiles, cleaning, targets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import target as C
from ..operators.roles import roles
from ..session import fresh_path
from ..sources import tables as A
from .frames import ACCOUNTS, accounts
from .registry import query, rounded, table
from .sql import big, hash_rank, quantile_cte, r

# -- sources ----------------------------------------------------------------------

ORDERS_CSV = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"


@query("csv_write_and_scan", ["A1", "A3"],
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def csv_write_and_scan(spark, folder):
    path = fresh_path(spark, "orders-csv")
    A.write_table(table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), path, "csv")
    return A.read_csv(spark, path, ORDERS_CSV)


@query("source_validation", ["A2"], f"SELECT {big('count(*)')} AS n_rows, {big('11')} AS n_columns FROM lineitem")
def source_validation(spark, folder):
    li = A.validate_source(table(spark, folder, "lineitem"))
    return li.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(li.columns)).cast("bigint").alias("n_columns"))


@query("target_check", ["A6"], f"SELECT quality, {big('count(*)')} AS n FROM labels GROUP BY quality")
def target_check(spark, folder):
    return C.check_target(table(spark, folder, "labels"), "quality").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


# -- profiles ---------------------------------------------------------------------

def patchy(spark, folder):
    """Customers with gaps, a mostly empty column and a constant one."""
    return table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_acctbal") < 4000, F.col("c_acctbal")).alias("low_balance"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.lit("x").alias("channel"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("Churn"), F.col("c_acctbal").alias("balance"))


PATCHY = """
patchy AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 4000 THEN c_acctbal END AS low_balance,
  nullif(c_mktsegment, 'BUILDING') AS segment, 'x' AS channel, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS "Churn",
  c_acctbal AS balance FROM customer)"""
PATCHY_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "low_balance": "double",
                "segment": "string", "channel": "string", "Churn": "int", "balance": "double"}


def _profile_sql(types, source):
    return " UNION ALL ".join(f"""
SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{t}' AS dtype, {big('count(*)')} AS row_count,
  {big(f'count(*) - count("{c}")')} AS null_count, round(1 - count("{c}") / CAST(count(*) AS DOUBLE), 4) AS null_pct,
  {big(f'count(DISTINCT "{c}")')} AS cardinality,
  (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY k) FROM
    (SELECT "{c}" AS v, c_custkey AS k FROM {source} WHERE "{c}" IS NOT NULL ORDER BY c_custkey LIMIT 5)) AS sample_values
FROM {source}""" for i, (c, t) in enumerate(types.items()))


@query("column_profile", ["B1"], f"WITH {PATCHY} {_profile_sql(PATCHY_TYPES, 'patchy')}")
def column_profile(spark, folder):
    return P.profile(patchy(spark, folder), ["c_custkey"]).drop("null_fraction", "cardinality_error").withColumn(
        "sample_values", F.concat_ws(",", "sample_values"))


@query("quality_issues", ["B2"], f"""WITH {PATCHY}, facts AS ({_profile_sql(PATCHY_TYPES, 'patchy')})
SELECT "column", CASE WHEN null_count > 0.3 * row_count THEN 'high_nulls' ELSE 'constant_column' END AS issue_type,
  CASE WHEN null_count > 0.3 * row_count THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN null_count > 0.3 * row_count THEN printf('null in %.1f%% of rows', null_count * 100.0 / row_count)
    ELSE 'one distinct value' END AS description
FROM facts WHERE null_count > 0.3 * row_count OR cardinality = 1""")
def quality_issues(spark, folder):
    return P.quality_issues(P.profile(patchy(spark, folder), samples=0, exact=False))


GUESS_TABLES = {"labels": ["doc_id", "quality", "toxic"],
                "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
                "patchy": list(PATCHY_TYPES), "keys": ["o_orderkey", "o_custkey"]}
_STRINGS = {"o_orderstatus", "o_orderpriority", "p_name", "p_brand", "p_type", "c_name", "segment", "channel"}


def _guess_sql():
    facts = " UNION ALL ".join(
        f"SELECT '{t}' AS source, {i} AS position, '{c}' AS c, {str(c in _STRINGS).lower()} AS is_text, count(DISTINCT \"{c}\") AS card FROM {t}"
        for t, cols in GUESS_TABLES.items() for i, c in enumerate(cols))
    hints = ", ".join(f"'{h}'" for h in P.TARGET_HINTS)
    return f"""WITH {PATCHY}, keys AS (SELECT o_orderkey, o_custkey FROM orders), facts AS ({facts}),
scored AS (SELECT *, CASE WHEN lower(c) IN ({hints}) THEN 1000 - position
  WHEN card <= 10 THEN 100 + position ELSE position END AS rank_score FROM facts),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC) AS rn FROM scored) WHERE rn = 1)"""


def _guess_profiles(spark, folder):
    for t, cols in GUESS_TABLES.items():
        df = patchy(spark, folder) if t == "patchy" else table(spark, folder, "orders" if t == "keys" else t).select(*cols)
        yield t, P.profile(df, samples=0, exact=False)


def _stack(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


@query("target_guess", ["B3"], _guess_sql() + " SELECT source, c AS suggested_target_col FROM best")
def target_guess(spark, folder):
    return _stack(P.guess_target(p).withColumn("source", F.lit(t)) for t, p in _guess_profiles(spark, folder))


@query("binarization_advice", ["B4"], _guess_sql() + """
SELECT source, c AS suggested_target_col,
  CASE WHEN card = 2 THEN 'already_binary' WHEN card > 2 AND is_text THEN 'label_encode' ELSE 'threshold' END AS strategy,
  CASE WHEN card = 2 OR (card > 2 AND is_text) THEN 'binary_classification' ELSE 'regression' END AS problem_type,
  CASE WHEN card = 2 THEN 'medium' ELSE 'low' END AS confidence FROM best""")
def binarization_advice(spark, folder):
    return _stack(P.recommend_binarization(p).withColumn("source", F.lit(t)) for t, p in _guess_profiles(spark, folder))


def _meta_sql(types, source):
    parts = []
    for c, t in types.items():
        null = f'round(100 - count("{c}") * 100 / CAST(count(*) AS DOUBLE), 1) AS null_pct'
        if t == "string":
            parts.append(f"""SELECT '{c}' AS "column", 'categorical' AS type, {null}, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, {big(f'count(DISTINCT "{c}")')} AS "unique",
  (SELECT "{c}" FROM {source} WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC, "{c}" LIMIT 1) AS top_val FROM {source}""")
        else:
            x = f'CAST("{c}" AS DOUBLE)'
            parts.append(f"""SELECT '{c}' AS "column", 'numeric' AS type, {null}, {r(f'avg({x})', 3)} AS mean, {r(f'stddev_samp({x})', 3)} AS std,
  {r(f'min({x})', 3)} AS min, {r(f'max({x})', 3)} AS max, {big(f'count(DISTINCT "{c}")')} AS "unique", CAST(NULL AS VARCHAR) AS top_val FROM {source}""")
    return " UNION ALL ".join(parts)


@query("feature_metadata", ["B5"], f"WITH {PATCHY} {_meta_sql(PATCHY_TYPES, 'patchy')}")
def feature_metadata(spark, folder):
    return P.feature_meta(patchy(spark, folder))


# -- cleaning ---------------------------------------------------------------------

# Columns of dates as text: Spark's pattern, and DuckDB's to write and to read them.
MESSY_DATES = {
    "stamped": ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ", "%Y-%m-%dT%H:%M:%S.%gZ"),
    "named": ("d MMM yyyy", "%-d %b %Y", "%d %b %Y"), "slashed": ("yyyy/MM/dd", "%Y/%m/%d", "%Y/%m/%d"), "monthly": ("yyyy-MM", "%Y-%m", "%Y-%m"),
}


def messy(spark, folder):
    """Orders with one column for each cleaning rule, and some for none."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").cast("string").alias("placed_on"),
        *[F.date_format("o_orderdate", f).alias(c) for c, (f, _, _) in MESSY_DATES.items()],
        F.concat(F.lit("ref "), F.col("o_orderkey").cast("string")).alias("reference"),
        F.col("o_totalprice").alias("price"), F.lit(7).alias("fixed"),
        F.when(F.col("o_custkey") % 3 == 0, "only").alias("fixed_or_null"),
        (F.lit(1e9) + F.col("o_totalprice") / 1e9).alias("steady"),
        F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 7).alias("seasonal_index"))


MESSY = f"""
messy AS (SELECT o_orderkey AS row_id, o_custkey, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS placed_on,
  {", ".join(f"strftime(o_orderdate, '{w}') AS {c}" for c, (_, w, _) in MESSY_DATES.items())},
  concat('ref ', CAST(o_orderkey AS VARCHAR)) AS reference, o_totalprice AS price, 7 AS fixed,
  CASE WHEN o_custkey % 3 = 0 THEN 'only' END AS fixed_or_null, CAST(1e9 AS DOUBLE) + o_totalprice / 1e9 AS steady,
  o_orderpriority AS priority, o_custkey % 7 AS seasonal_index FROM orders)"""
MESSY_COLS = {"row_id": 0, "o_custkey": 0, "status": 1, "placed_on": 1, **{c: 1 for c in MESSY_DATES}, "reference": 1, "price": 0, "fixed": 0,
              "fixed_or_null": 1, "steady": 0, "priority": 1, "seasonal_index": 0}


def _checks_sql():
    endings = "|".join(f"{e}$" for e in P.ID_ENDINGS) + "|^id$|^key$|^uuid$|^code$"
    rows = []
    for i, (c, text) in enumerate(MESSY_COLS.items()):
        formats = ", ".join(f"'{f}'" for f in ["%Y-%m-%d", *[x for _, _, x in MESSY_DATES.values()]])
        date = f"coalesce(avg(CASE WHEN {c} IS NOT NULL THEN (try_strptime({c}, [{formats}]) IS NOT NULL)::INTEGER END) > 0.8, false)" if text else "false"
        spread = f"stddev_samp({c}) / (abs(avg({c})) + 1e-9) < 1e-5" if not text else "false"
        unique = f"count(DISTINCT {c}) > 0.2 * count(*)" if text else "false"
        rows.append(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END <= 1 AS is_constant,
  {date} AS is_date_like, regexp_matches('{c}', '{endings}') OR {unique} AS is_identifier, {spread} AS is_near_zero_variance FROM messy""")
    return f"WITH {MESSY}, checks AS ({' UNION ALL '.join(rows)})"


for _name, _id, _flag in (("constant_columns", "B6a", "is_constant"), ("date_like_columns", "B6b", "is_date_like"),
                          ("identifier_columns", "B6c", "is_identifier"), ("near_zero_variance_columns", "B6d", "is_near_zero_variance")):
    @query(_name, [_id], _checks_sql() + f' SELECT "column" FROM checks WHERE {_flag}')
    def _rule(spark, folder, flag=_flag):
        return P.column_checks(messy(spark, folder), ["row_id"]).filter(flag).select("column")


@query("feature_cleaning", ["B6"], _checks_sql() + """
SELECT "column", CASE WHEN is_constant THEN 'constant' WHEN is_date_like THEN 'date_string' WHEN is_identifier THEN 'identifier'
  ELSE 'near_zero_variance' END AS reason FROM checks
WHERE "column" <> 'status' AND (is_constant OR is_date_like OR is_identifier OR is_near_zero_variance)""")
def feature_cleaning(spark, folder):
    return P.drop_reasons(messy(spark, folder), "status", ["row_id"])


@query("cleaned_table", ["B6"], f"WITH {MESSY} SELECT o_custkey, status, price, fixed_or_null, priority FROM messy")
def cleaned_table(spark, folder):
    return P.clean_features(messy(spark, folder), "status", ["row_id"])[0]


@query("role_partition", ["B9"], " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS role, {big(f'count({c})')} AS n_values FROM lineitem"
    for c, k in [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
                 ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
                 ("l_linestatus", "categorical")]))
def role_partition(spark, folder):
    li = table(spark, folder, "lineitem")
    found = roles(li, exclude=["l_returnflag"])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("role"), F.col(f"n_{c}").alias("n_values"))
        for k, cols in (("numeric", found.numeric), ("categorical", found.categorical)) for c in cols])
    return li.agg(*[F.count(c).alias(f"n_{c}") for c in found.features]).select(F.explode(cells).alias("e")).select("e.*")


# -- splits and their summary -----------------------------------------------------

_SPLIT_SQL = f"""
ranked AS (SELECT *, {hash_rank('o_orderkey', 42, 'o_orderstatus')} AS rk, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
splits AS (SELECT *, CASE WHEN rk < (12 * n + 10) // 20 THEN 'train' WHEN rk < (16 * n + 10) // 20 THEN 'test'
  WHEN rk < (18 * n + 10) // 20 THEN 'oot' ELSE 'etrc' END AS split FROM ranked)"""


def _split_orders(spark, folder):
    return C.stratified_split(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"])


@query("stratified_split", ["C4"], f"WITH {_SPLIT_SQL} SELECT o_orderkey, o_orderstatus, split FROM splits")
def stratified_split(spark, folder):
    return _split_orders(spark, folder).select("o_orderkey", "o_orderstatus", "split")


@query("dataset_summary", ["B7"], f"SELECT {big('count(*)')} AS n_rows, {big('5')} AS n_features, {big('3')} AS n_numeric, {big('2')} AS n_categorical FROM orders")
def dataset_summary(spark, folder):
    return P.table_summary(_split_orders(spark, folder), "o_orderstatus", ["split"])


@query("class_fractions_by_split", ["B7"], f"""WITH {_SPLIT_SQL}, c AS (SELECT split, o_orderstatus AS class, count(*) AS n FROM splits GROUP BY 1, 2)
SELECT split, class, {big('n')} AS n, {r('n / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE)')} AS fraction FROM c""")
def class_fractions_by_split(spark, folder):
    return rounded(P.class_balance(_split_orders(spark, folder), "o_orderstatus", ["split"]))


@query("class_balance", ["B8"], f"""SELECT CAST(quality AS VARCHAR) AS class, {big('count(*)')} AS n,
{r('count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE)')} AS fraction FROM labels GROUP BY quality""")
def class_balance(spark, folder):
    return rounded(P.class_balance(table(spark, folder, "labels"), "quality"))


def _fold_case(k):
    return "CASE " + " ".join(f"WHEN rk < n * {i + 1} // {k} THEN {i}" for i in range(k)) + " END"


@query("stratified_folds", ["C5"], f"""WITH ranked AS (SELECT *, {hash_rank('o_orderkey', 7, 'o_orderstatus')} AS rk,
count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CAST({_fold_case(5)} AS INTEGER) AS fold FROM ranked""")
def stratified_folds(spark, folder):
    return C.stratified_folds(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"], 5, 7).select("o_orderkey", "o_orderstatus", "fold")


@query("plain_folds", ["C6"], f"""WITH ranked AS (SELECT *, {hash_rank('event_id', 42, None)} AS rk, count(*) OVER () AS n FROM events)
SELECT event_id, CAST({_fold_case(5)} AS INTEGER) AS fold FROM ranked""")
def plain_folds(spark, folder):
    return C.folds(table(spark, folder, "events"), ["event_id"]).select("event_id", "fold")


@query("time_ordered_split", ["C7"], f"""WITH t AS (SELECT event_id, epoch_us(ts) AS us FROM events), {quantile_cte('cut', 't', 'us', 9, 10)}
SELECT event_id, CASE WHEN us > q THEN 'oot' ELSE 'train' END AS split FROM t, cut""")
def time_ordered_split(spark, folder):
    return C.split_by_time(table(spark, folder, "events"), "ts", recent=0.1).select("event_id", "split")


# -- binary targets ---------------------------------------------------------------

def _binarized(df, col, key, **kw):
    return C.binarize_target(df.select(key, col), col, out="y", **kw).select(key, "y")


@query("binarize_already_binary", ["C1"], "SELECT doc_id, CAST(quality AS INTEGER) AS y FROM labels")
def binarize_already_binary(spark, folder):
    return _binarized(table(spark, folder, "labels"), "quality", "doc_id")


@query("binarize_positive_class", ["C1"], f"WITH {ACCOUNTS} SELECT id, CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS y FROM acc")
def binarize_positive_class(spark, folder):
    return _binarized(accounts(spark, folder), "segment", "id", positive_class="MACHINERY")


@query("binarize_threshold", ["C1"], f"WITH {ACCOUNTS} SELECT id, CASE WHEN balance > 2500 THEN 1 ELSE 0 END AS y FROM acc")
def binarize_threshold(spark, folder):
    return _binarized(accounts(spark, folder), "balance", "id", threshold=2500)


@query("binarize_median", ["C1"], f"""WITH {ACCOUNTS}, {quantile_cte('mid', 'acc', 'balance', 1, 2)}
SELECT id, CASE WHEN balance > q THEN 1 ELSE 0 END AS y FROM acc, mid""")
def binarize_median(spark, folder):
    return _binarized(accounts(spark, folder), "balance", "id")


@query("binarize_against_mode", ["C1"], f"""WITH {ACCOUNTS}, top AS (SELECT segment AS m FROM acc WHERE segment IS NOT NULL
  GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT id, CASE WHEN segment IS DISTINCT FROM m THEN 1 ELSE 0 END AS y FROM acc, top""")
def binarize_against_mode(spark, folder):
    return _binarized(accounts(spark, folder), "segment", "id")


@query("decision_label", ["C2"], "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'default' ELSE 'no_default' END AS decision FROM orders")
def decision_label(spark, folder):
    o = table(spark, folder, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return o.select("o_orderkey", C.decision_label("y").alias("decision"))


@query("top_quantile_flag", ["C3"], f"""WITH {quantile_cte('cut', 'orders', 'o_totalprice', 17, 20)}
SELECT o_orderkey, CASE WHEN o_totalprice > q THEN 1 ELSE 0 END AS flag FROM orders, cut""")
def top_quantile_flag(spark, folder):
    return C.top_quantile_flag(table(spark, folder, "orders"), "o_totalprice", 0.15).select("o_orderkey", "flag")
