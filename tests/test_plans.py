"""The plan fragments: exact whatever the sketches say, and on the paths that large data takes."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators.target import stratified_folds
from riskloom.plans.hashcuts import DRIVER_STRATA, CutTable, Ranks, assign_blocks, hash_cuts
from riskloom.plans.ordered import plan_order, row_numbers, running_totals
from riskloom.plans.quantiles import exact_quantiles
from riskloom.plans.rows import attach

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    kept = [v for v in values if v is not None]
    got = exact_quantiles(df, ["v"], [i / 10 for i in range(11)])["v"]
    if not kept:
        assert got is None
    else:
        assert np.allclose(got, np.percentile(kept, np.arange(0, 101, 10)), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("hot", [False, True])
def test_narrowed_quantiles_are_exact(spark, hot):
    rng = np.random.default_rng(5)
    v = np.round(rng.lognormal(3, 1.5, 20_000), 3)
    if hot:  # a third of all rows share one value
        v[: len(v) // 3] = 42.0
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [i / 10 for i in range(11)] + [0.25, 0.999]
    narrowed = exact_quantiles(df, ["v"], probs, max_distinct=200, accuracy=200)["v"]
    assert narrowed == exact_quantiles(df, ["v"], probs)["v"]
    assert np.allclose(narrowed, np.percentile(v, [100 * p for p in probs]))


def test_edge_on_a_data_point_is_that_point(spark):
    df = spark.createDataFrame([(0.1 * i,) for i in range(31)], "v double")
    got = exact_quantiles(df, ["v"], [i / 10 for i in range(11)])["v"]
    assert got == [0.1 * i for i in range(0, 31, 3)]


@pytest.fixture(scope="module")
def scores(spark):
    """One group holds most rows, and half of those share one score."""
    rng = np.random.default_rng(3)
    n = 6_000
    s = np.round(rng.random(n), 2)
    s[: n // 3] = 0.5
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": np.where(np.arange(n) % 6 == 0, "small", "big"), "s": s,
                        "y": (rng.random(n) < 0.3).astype(int)})
    return spark.createDataFrame(pdf).repartition(5).persist()


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_in_buckets(scores, by, descending):
    order = plan_order(scores, by, "s", tiebreak="id", rows_per_bucket=150)
    assert order.cuts is not None and order.sub_cuts is not None
    first = F.col("s").desc() if descending else F.col("s")
    w = Window.partitionBy(*by).orderBy(first, "id")
    both = row_numbers(scores, order, "a", descending=descending).withColumn("b", F.row_number().over(w))
    assert both.filter("a <> b").count() == 0 and both.count() == scores.count()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_in_buckets(scores, by):
    order = plan_order(scores, by, "s", rows_per_bucket=150)
    groups = scores.groupBy(*by, "s").agg(F.sum("y").alias("n"))
    got = running_totals(groups, order, ["n"], following=["n"])
    w = Window.partitionBy(*by).orderBy("s")
    both = got.withColumns({"t": F.sum("n").over(w), "f": F.lead("n").over(w)})
    assert both.filter("cum_n <> t or not (next_n <=> f)").count() == 0


def test_bucketed_rows_spread_over_tasks(scores):
    """No bucket, not even that of the hot score, is much above its size."""
    order = plan_order(scores, ["g"], "s", tiebreak="id", rows_per_bucket=150)
    top = order.with_bucket(scores).groupBy("g", "__bucket", "__sub").count().agg(F.max("count")).first()[0]
    assert top <= 450


@pytest.mark.parametrize("by", [[], ["g"]])
def test_metrics_in_buckets_read_the_rows_once(spark, scores, by):
    """Metrics are summed per bucket: no second reading for offsets, and the values are those of uncut groups."""
    from plancheck import plan_text

    from riskloom.operators.evaluate import METRICS, evaluate

    rows = scores.select("g", "y", (F.col("s") / (1 + F.abs("s")) / 2 + 0.5).alias("s"))
    cut, whole = evaluate(rows, "y", "s", by=by, rows_per_bucket=150), evaluate(rows, "y", "s", by=by)
    got, expected = ({r["g"] if by else 0: r for r in e.collect()} for e in (cut, whole))
    for g, r in expected.items():
        assert [got[g][m] for m in METRICS] == pytest.approx([r[m] for m in METRICS], rel=1e-12)
        part = rows.filter(F.col("g") == g).toPandas() if by else rows.toPandas()
        p, q = part.s[part.y == 1].to_numpy(), part.s[part.y == 0].to_numpy()
        assert got[g]["roc_auc"] == pytest.approx(((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / len(p) / len(q))
        assert got[g]["ks_statistic"] == pytest.approx(100 * max(abs((p <= s).mean() - (q <= s).mean()) for s in part.s.unique()))
    # of a source that is no kept table, so that each reading shows
    source = spark.range(3_000).selectExpr("id % 2 AS g", "CAST(id % 3 = 0 AS int) AS y", "id % 997 / 997 AS s")
    plan = plan_text(evaluate(source, "y", "s", by=by, rows_per_bucket=150))
    assert plan.split("== Initial Plan ==")[0].count("Range (") == 1


_ORDERED = {  # values that a cut by their first bytes, or as doubles, cannot tell apart
    "string": "concat('customer-', lpad(cast(id % 2500 AS string), 8, '0'))",
    "long": "9007199254740992 + id % 2500",
    "decimal": "CAST(12345678901234567890 + id % 2500 AS decimal(25, 0))",
    "date": "date_add(DATE'2020-01-01', CAST(id % 2500 AS int))",
    "timestamp": "timestamp_micros(1700000000000000 + id % 2500)",
    "double with nan": "CASE WHEN id % 11 = 0 THEN double('nan') ELSE id % 2500 / 7 END",
    "hot": "CASE WHEN id % 2 = 0 THEN 'customer-hot' WHEN id % 7 <> 0 THEN concat('customer-', cast(id % 2500 AS string)) END",
}


@pytest.mark.parametrize("kind", _ORDERED)
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_of_any_type(spark, kind, by, descending):
    """Buckets follow the column's own order, and ties the tie-break's, whatever their types."""
    df = spark.range(5_000).selectExpr("id % 5 > 0 AS g", f"{_ORDERED[kind]} AS v", "concat('key-number-', id * 7919 % 5000) AS k")
    order = plan_order(df, by, "v", tiebreak="k", rows_per_bucket=100)
    assert order.cuts is not None and (kind != "hot" or order.sub_cuts is not None)
    w = Window.partitionBy(*by).orderBy(F.col("v").desc() if descending else F.col("v"), "k")
    both = row_numbers(df, order, "a", descending=descending).withColumn("b", F.row_number().over(w))
    assert both.filter("a <> b").count() == 0 and both.count() == 5_000


@pytest.mark.parametrize("kind", ["string", "long", "decimal", "hot"])
def test_buckets_of_a_shared_prefix_are_balanced(spark, kind):
    df = spark.range(50_000).selectExpr(f"{_ORDERED[kind]} AS v", "concat('key-number-', id * 7919 % 50000) AS k").filter("v IS NOT NULL")
    if kind == "long":  # a sketch of longs works on doubles: spread them beyond their resolution
        df = df.withColumn("v", F.col("v") * 512)
    order = plan_order(df, [], "v", tiebreak="k", rows_per_bucket=1_000)
    top = order.with_bucket(df).groupBy("__bucket", "__sub").count().agg(F.max("count")).first()[0]
    assert top <= 3_000


def test_only_oversize_groups_are_sketched(spark):
    df = spark.range(6_000).selectExpr("CASE WHEN id < 3000 THEN 'big' ELSE CAST(id AS string) END AS g", "id AS v")
    order = plan_order(df, ["g"], "v", rows_per_bucket=500)
    assert [r.g for r in order.cuts.collect()] == ["big"]


@pytest.mark.parametrize("rows_per_task", [1, 100, 1_000_000])
def test_hash_cuts_have_exact_sizes(scores, rows_per_task):
    cuts = hash_cuts(scores, ["id"], 9, F.col("g"), lambda n: [0, n // 3, n // 2, n], rows_per_task=rows_per_task)
    out = assign_blocks(scores, ["id"], 9, F.col("g"), cuts, "b").groupBy("g", "b").count().collect()
    for g, n in (("big", 5_000), ("small", 1_000)):
        sizes = {r["b"]: r["count"] for r in out if r["g"] == g}
        assert sizes == {1: n // 3, 2: n // 2 - n // 3, 3: n - n // 2}


@pytest.mark.parametrize("rows_per_task", [3, 1_000_000])
def test_cuts_by_table_are_those_of_the_driver(spark, rows_per_task):
    """A hot stratum, many small ones, null; every row falls into the same block either way."""
    df = spark.range(4_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 != 1, (F.col("id") % 37).cast("string")).alias("g"))
    ranks = Ranks([Fraction(0), Fraction(1, 3), Fraction(1, 3), Fraction(7, 10), Fraction(1)], half_up=True)
    of = lambda n: assign_blocks(
        df, ["id"], 9, F.col("g"), hash_cuts(df, ["id"], 9, F.col("g"), ranks, rows_per_task=rows_per_task, driver_strata=n), "b")
    assert isinstance(hash_cuts(df, ["id"], 9, F.col("g"), ranks, driver_strata=38), CutTable)
    few, many = of(64), of(10)
    assert few.columns == many.columns and sorted(few.collect(), key=str) == sorted(many.collect(), key=str)


def test_a_hundred_thousand_strata(spark, monkeypatch):
    """Fold sizes differ by one at most in each stratum, and no row of a stratum comes to the driver."""
    df = spark.range(500_000).select("id", (F.col("id") % 100_000).alias("g"))
    big = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: big.append(rows := real(self)) or rows)
    out = stratified_folds(df, "g", ["id"], 5)
    assert max(map(len, big)) <= DRIVER_STRATA * 16**3 + 1 and len(big) == 1
    sizes = out.groupBy("g", "fold").count()
    assert sizes.count() == 500_000 and sizes.filter("count <> 1").isEmpty()


def test_attach_beyond_the_broadcast_limit(spark):
    """A hot key, many cold ones, an unknown one and nulls, joined by shuffle."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 400}", i) for i in range(3_000)] + [(None, -1), ("unseen", -2), ("", -3)]
    df = spark.createDataFrame(rows, "k string, i int")
    table = df.filter("k not in ('unseen', '')").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").cast("double").alias("v"))
    small = attach(df, table, ["k"], table_rows=500, weight="n")
    large = attach(df, table, ["k"], table_rows=500, weight="n", hot_share=0.05, broadcast_rows=10)
    assert large.columns == small.columns == ["k", "i", "v"]
    assert sorted(large.collect(), key=str) == sorted(small.collect(), key=str)
    assert large.filter("i < 0 and v is not null").count() == 0


def test_cut_levels(spark):
    from riskloom.plans.ordered import _cut_table, _cuts_at_or_below, _levels

    for n in (1, 16, 17, 256, 300, 5000):
        cuts = [float(2 * i) for i in range(n)]
        table = _cut_table(spark, [], [(cuts,)], len(_levels(cuts)))
        xs = [-1.0, 0.0, 1.0, 33.0, float(n), 2.0 * n - 2, 9e9, None]
        df = spark.createDataFrame([(x,) for x in xs], "x double").crossJoin(table)
        got = {r["x"]: r["b"] for r in _cuts_at_or_below(df, F.col("x"), table, "b").collect()}
        assert got == {x: 0 if x is None else sum(c <= x for c in cuts) for x in xs}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_few_scores_of_many_rows_are_not_cut(spark, monkeypatch, by):
    """Metrics order distinct scores: a group of many rows and few scores needs no cuts, next to one of many scores that does."""
    from riskloom.operators.evaluate import evaluate
    from riskloom.plans import ordered

    wide = (F.col("id") % 4_000) / 4_000 if by else (F.col("id") % 8) / 8
    df = spark.range(6_000).select("id", (F.hash("id") % 2 == 0).cast("int").alias("y"), F.when(F.col("id") % 3 == 0, "few").otherwise("many").alias("g"), wide.alias("s"))
    df = df.withColumn("s", F.when(F.col("g") == "few", F.col("id") % 7 / 7).otherwise(F.col("s")))
    whole = evaluate(df, "y", "s", by=by).drop("confusion").collect()
    cut, real = [], ordered._splitters
    monkeypatch.setattr(ordered, "_splitters", lambda large, *a: cut.extend(r["g"] for r in large.select(*by).distinct().collect() if by) or cut.append("cut") or real(large, *a))
    parts = evaluate(df, "y", "s", by=by, rows_per_bucket=500).drop("confusion").collect()
    assert cut == (["many", "cut"] if by else [])
    for a, b in zip(sorted(whole, key=str), sorted(parts, key=str)):
        assert a.asDict().keys() == b.asDict().keys() and all(v == (w if isinstance(w, str) else pytest.approx(w, rel=1e-12)) for v, w in zip(a, b))


def test_settled_tables_go_with_their_run(spark, tmp_path):
    from riskloom.session import exists, run_folder, settle

    with run_folder(spark) as outer:
        a = settle(spark.range(3), "a")
        with run_folder(spark) as inner:
            settle(spark.range(4), "b").write.parquet(f"{tmp_path}/kept")
            assert exists(spark, inner)
        assert not exists(spark, inner) and a.count() == 3
    assert not exists(spark, outer) and spark.read.parquet(f"{tmp_path}/kept").count() == 4
    with pytest.raises(ZeroDivisionError), run_folder(spark) as broken:
        settle(spark.range(2))
        raise ZeroDivisionError
    assert not exists(spark, broken)
