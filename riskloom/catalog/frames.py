"""Input frames of the registered queries: the given tables in the roles the operators need.

Each frame has an SQL twin of the same name. The tables hold no nulls, so the frames blank
out some values where a null rule has to show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from .registry import table


def null_if(col: str, value):
    return F.nullif(F.col(col), F.lit(value))


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with order and part attributes; y marks a return."""
    li, o, p = (table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    li = spread(li, "l_orderkey")  # given as one file of one row group; several passes follow
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
            null_if("l_quantity", 25.0).alias("quantity"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"), null_if("l_tax", 0.05).alias("tax"),
            null_if("o_orderpriority", "3-MEDIUM").alias("priority"), F.col("p_type").alias("type"),
            F.col("p_brand").alias("brand"), F.col("l_suppkey").cast("string").alias("supplier"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
        )
    )


SHIPMENTS = """
ship AS (SELECT nullif(l_quantity, 25.0) AS quantity, l_extendedprice AS price, l_discount AS discount,
  nullif(l_tax, 0.05) AS tax, nullif(o_orderpriority, '3-MEDIUM') AS priority, p_type AS type, p_brand AS brand,
  CAST(l_suppkey AS VARCHAR) AS supplier, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SHIP_NUMERIC = ["quantity", "price", "discount"]
SHIP_CATEGORICAL = ["tax", "priority", "type", "brand"]


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer attributes; y marks a finished order."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        null_if("c_mktsegment", "BUILDING").alias("segment"), F.col("o_orderpriority").alias("priority"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


ACCOUNTS = """
acc AS (SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
  nullif(c_mktsegment, 'BUILDING') AS segment, o_orderpriority AS priority, CAST(c_nationkey AS VARCHAR) AS nation,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Two closed-form scorecards over all orders, rounded so that scores tie; four splits."""
    o = table(spark, folder, "orders")
    z = (F.col("o_totalprice") - 250000.0) / 125000.0
    late = F.when(F.col("o_orderstatus") == "F", 0.4).otherwise(-0.2)
    cell = lambda name, x: F.struct(
        F.lit(name).alias("model"), F.round(1.0 / (1.0 + F.exp(-x)), 3).alias("score"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "test").when(F.col("o_orderpriority") == "3-MEDIUM", "oot")
        .when(F.col("o_orderpriority") == "5-LOW", "etrc").otherwise("train").alias("split"),
        F.explode(F.array(cell("price", z), cell("blend", z * 0.5 + late))).alias("e"),
    ).select("id", "label", "split", "e.model", "e.score").withColumn("pred", (F.col("score") >= 0.5).cast("int"))


SCORED = """
scored AS (SELECT id, label, split, model, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
  SELECT id, label, split, 'price' AS model, round(1 / (1 + exp(-z)), 3) AS score FROM base
  UNION ALL SELECT id, label, split, 'blend', round(1 / (1 + exp(-(z * CAST(0.5 AS DOUBLE) + late))), 3) FROM base))"""
SCORED = """
base AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'test' WHEN '3-MEDIUM' THEN 'oot' WHEN '5-LOW' THEN 'etrc' ELSE 'train' END AS split,
  (o_totalprice - 250000) / CAST(125000 AS DOUBLE) AS z,
  CASE WHEN o_orderstatus = 'F' THEN CAST(0.4 AS DOUBLE) ELSE CAST(-0.2 AS DOUBLE) END AS late FROM orders),""" + SCORED


def before_after(spark: SparkSession, folder: str):
    """Line items shipped before 1998 against those after, with a planted shift."""
    li = table(spark, folder, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    cols = {
        "price": F.col("l_extendedprice"), "quantity": F.col("l_quantity"),
        "discount": F.when(late, F.col("l_discount") * 1.5).otherwise(F.col("l_discount")),
        "tax": F.when(F.col("l_tax") != 0.03, F.col("l_tax")),
        "shifted": F.when(late, F.col("l_quantity") + 9).otherwise(F.col("l_quantity")),
        "is_returned": F.when(late, (F.col("l_linenumber") <= 5)).otherwise(F.col("l_linenumber") <= 1).cast("int"),
        "mode": F.when(late & (F.col("l_returnflag") == "A"), "Z").otherwise(F.col("l_returnflag")),
    }
    frame = li.select(*[c.alias(n) for n, c in cols.items()], late.alias("late"))
    return frame.filter(~F.col("late")).drop("late"), frame.filter("late").drop("late")


BEFORE_AFTER = """
moved AS (SELECT l_extendedprice AS price, l_quantity AS quantity,
  CASE WHEN late THEN l_discount * CAST(1.5 AS DOUBLE) ELSE l_discount END AS discount, nullif(l_tax, 0.03) AS tax,
  CASE WHEN late THEN l_quantity + 9 ELSE l_quantity END AS shifted,
  CASE WHEN l_linenumber <= CASE WHEN late THEN 5 ELSE 1 END THEN 1 ELSE 0 END AS is_returned,
  CASE WHEN late AND l_returnflag = 'A' THEN 'Z' ELSE l_returnflag END AS mode, late
  FROM (SELECT *, l_shipdate >= TIMESTAMP '1998-01-01' AS late FROM lineitem)),
before AS (SELECT * FROM moved WHERE NOT late),
after AS (SELECT * FROM moved WHERE late)"""

DRIFT_COLUMNS = ["price", "quantity", "discount", "tax", "shifted"]


def first_week_events(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline of the windowed drift queries."""
    return table(spark, folder, "events").filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).select("value")


def supplier_months(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity and revenue per supplier and month: counted before anything is ordered."""
    li = table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("supplier"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("period")).agg(
        F.sum("l_quantity").alias("units"))


SUPPLIER_MONTHS = """
months AS (SELECT l_suppkey AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, sum(l_quantity) AS units
  FROM lineitem GROUP BY 1, 2)"""
