"""Formulas against plain numpy on small inputs, edge cases, and properties."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import drift, evaluate, preprocess, profile, target, timeframe
from riskloom.operators.encode import SmartEncoder, TargetEncoder, WOEEncoder
from riskloom.sources.tables import validate_source

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=str)


# -- targets ----------------------------------------------------------------------

def test_binarize_null_rules(spark):
    zero_one = spark.createDataFrame([("0",), ("1",), (None,)], "t string")
    with pytest.raises(ValueError):
        target.binarize_target(zero_one, "t")
    words = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    y = lambda df: [r["__target__"] for r in df.collect()]
    assert y(target.binarize_target(words, "t", positive_class="b")) == [0, 0, 1, 0]
    assert y(target.binarize_target(words, "t")) == [0, 0, 1, 1]
    numbers = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "t double")
    assert y(target.binarize_target(numbers, "t", threshold=6)) == [0] * 7 + [1, 1, 0]
    assert y(target.binarize_target(numbers, "t")) == [0] * 5 + [1] * 4 + [0]
    texts = spark.createDataFrame([(str(i),) for i in range(10)] + [("x",)], "t string")
    assert sum(y(target.binarize_target(texts, "t"))) == 5
    flags = spark.createDataFrame([(True,), (False,)], "t boolean")
    assert y(target.binarize_target(flags, "t")) == [1, 0]


def test_target_check(spark):
    df = spark.createDataFrame([(1,), (1,)], "y int")
    for bad in ("y", "missing"):
        with pytest.raises(ValueError):
            target.check_target(df, bad)
    with pytest.raises(ValueError):
        validate_source(df)
    with pytest.raises(ValueError):
        target.stratified_split(df, "y", ["y"], train_size=0.5)


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = target.stratified_split(df, "y", ["id"])
    b = target.stratified_split(df.repartition(7).sortWithinPartitions(F.desc("id")), "y", ["id"])
    assert rows(a, "id", "split") == rows(b, "id", "split")
    sizes = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert sizes[(1, "train")] == 100 and sizes[(1, "test")] == 34 and sizes[(1, "oot")] + sizes[(1, "etrc")] == 33


# -- cleaning ---------------------------------------------------------------------

def test_cleaning_rules(spark):
    n = 60
    df = spark.createDataFrame(
        [(i, "k", None if i % 2 else "v", f"2024-01-{i % 28 + 1:02d}", f"r{i}", 1e9, float(i), "ab"[i % 2]) for i in range(n)],
        "customer_id int, c string, half string, day string, ref string, flat double, x double, y string")
    clean, why = profile.clean_features(df, "y", ["x"])
    assert why == {"customer_id": "identifier", "c": "constant", "day": "date_string", "ref": "identifier", "flat": "constant"}
    assert clean.columns == ["half", "x", "y"]


def test_uniqueness_near_the_limit_is_exact(spark):
    for distinct, dropped in ((200, False), (201, True)):
        df = spark.range(1000).select((F.col("id") % 2).alias("y"), F.concat(F.lit("v"), F.col("id") % distinct).alias("s"))
        assert ("s" in profile.clean_features(df, "y")[1]) is dropped


def test_sketched_counts_say_so(spark):
    """Only columns of many values are sketched, and lie within the stated band of the exact count."""
    df = spark.range(20_000).selectExpr("id", "id % 40 AS few", "CAST(id % 7000 AS string) AS many", "CAST(NULL AS int) AS none")
    exact = {r["column"]: r for r in profile.profile(df, samples=0).collect()}
    fast = {r["column"]: r for r in profile.profile(df, samples=0, exact=False).collect()}
    assert {r["cardinality_error"] for r in exact.values()} == {0.0}
    assert {c for c, r in fast.items() if r["cardinality_error"]} == {"id", "many"}
    for c, r in fast.items():
        assert abs(r["cardinality"] - exact[c]["cardinality"]) <= 6 * r["cardinality_error"] * exact[c]["cardinality"]



def test_sparse_column_still_has_samples(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") > 4990, F.col("id")).alias("late"))
    got = {r["column"]: r["sample_values"] for r in profile.profile(df, ["id"]).collect()}
    assert got["late"] == ["4991", "4992", "4993", "4994", "4995"] and got["id"][0] == "0"


# -- encoders ---------------------------------------------------------------------

def numpy_woe(y, groups, r=0.5):
    E, N = y.sum(), (1 - y).sum()
    out = {}
    for g in groups:
        m = groups[g]
        e, n = (y[m].sum() + r) / (E + r), ((1 - y[m]).sum() + r) / (N + r)
        out[g] = (math.log(e / n), (e - n) * math.log(e / n), int(m.sum()))
    return out


def test_woe_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(400) < 0.1, np.nan, np.round(rng.normal(size=400), 1))
    c = rng.choice(["a", "b", None], 400)
    y = (rng.random(400) < 0.3).astype(int)
    df = spark.createDataFrame([(None if np.isnan(a) else float(a), b, int(t)) for a, b, t in zip(x, c, y)], "x double, c string, y int")
    model = WOEEncoder().fit(df, ["x", "c"], "y")
    edges = np.unique(np.percentile(x[~np.isnan(x)], np.arange(0, 101, 10)))
    bins = np.digitize(x, edges[1:-1])
    groups = {str(b): (bins == b) & ~np.isnan(x) for b in range(len(edges) - 1)} | {"__MISSING__": np.isnan(x)}
    got = {r["bin"]: (r["woe"], r["iv"], r["count"]) for r in model.report("x").collect()}
    want = numpy_woe(y, groups)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    words = np.array(["__MISSING__" if v is None else v for v in c])
    want_c = numpy_woe(y, {g: words == g for g in ("a", "b", "__MISSING__")})
    iv = {r["feature"]: r["iv"] for r in model.iv().collect()}
    assert np.isclose(iv["c"], sum(v[1] for v in want_c.values())) and np.isclose(iv["x"], sum(v[1] for v in want.values()))
    fresh = spark.createDataFrame([(99.0, "new"), (None, None)], "x double, c string")
    out = model.transform(fresh).select("x_woe", "c_woe").collect()
    assert np.allclose(out[0], (got[str(len(edges) - 2)][0], 0.0)) and np.allclose(out[1], (want["__MISSING__"][0], want_c["__MISSING__"][0]))
    with pytest.raises(ValueError):
        model.report("nope")


def test_woe_mode_fill(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 0)], "c string, y int")
    model = WOEEncoder(handle_missing="most_frequent").fit(df, ["c"], "y")
    assert rows(model.bins, "bin", "count") == [("a", 3), ("b", 1)]


def test_out_of_fold_ignores_own_fold(spark):
    data = [(i, f"c{i % 4}", (i * 7) % 3 == 0, i % 5) for i in range(100)] + [(100, "once", True, 0), (101, None, False, 1)]
    df = spark.createDataFrame([(i, c, int(y), f) for i, c, y, f in data], "id int, c string, y int, fold int")
    out = {r["id"]: r["c_te"] for r in TargetEncoder().fit_transform(df, ["c"], "y", ["id"], fold="fold").collect()}
    g = np.mean([y for _, _, y, _ in data])
    for i, c, _y, f in data:
        other = [b for _, k, b, h in data if k == c and c is not None and h != f]
        assert np.isclose(out[i], (sum(other) + g) / (len(other) + 1) if other else g)


def test_smart_encoder_choice(spark):
    df = spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("few"),
        (F.col("id") % 20).cast("string").alias("some"), (F.col("id") % 51).cast("string").alias("many"))
    model = SmartEncoder().fit(df, ["few", "some", "many"], "y")
    assert model.strategies == {"few": "onehot", "some": "woe", "many": "target"}
    out = model.transform(df)
    assert {"few_1", "few_2", "few_3", "few_null", "some", "many"} <= set(out.columns)
    assert out.filter("few_1 + few_2 + few_3 + few_null <> 1").count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, "a", i % 2) for i in range(20)], "x double, c string, y int")
    assert WOEEncoder().fit(df, ["x"], "y").bins.count() == 1
    assert preprocess.fit_numeric(df, ["x"])["x"].median == 0.0
    psi = drift.psi(df, df, "x").collect()[0]
    assert psi["psi"] is None and psi["status"] is None
    model = preprocess.fit_preprocessor(df, ["x"], ["c"])
    assert model.transform(df).count() == 20


@pytest.mark.parametrize("limit, slots", [(299, 64), (300, 300), (301, 300)])
def test_wide_columns_are_hashed(spark, limit, slots):
    """The limit holds to the level, whatever a sketch says; hashed slots have names and count each row once."""
    df = spark.range(600).select((F.col("id") % 300).cast("string").alias("c"), F.lit("x").alias("few"), F.lit(1.0).alias("n"))
    model = preprocess.fit_preprocessor(df, ["n"], ["c", "few"], max_levels=limit, hash_slots=64)
    names = preprocess.feature_names(model)
    assert len(names) == 1 + slots + 1 and names[0] == "num__n" and names[-1] == "cat__few_x"
    assert names[1].startswith("cat__c#" if slots == 64 else "cat__c_")
    assert [(c, len(n)) for c, n in preprocess.slot_groups(model)] == [("n", 1), ("c", slots), ("few", 1)]
    ones = model.transform(df).select(F.aggregate(F.slice(vector_to_array("features"), 2, slots), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert ones.distinct().collect() == [(1.0,)]


# -- evaluation -------------------------------------------------------------------

def numpy_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), min_size=4, max_size=50))
def test_auc_ks_properties(spark, pairs):
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] / 10 for p in pairs])
    if len(set(y)) < 2:
        return
    df = spark.createDataFrame([(int(a), float(b), float(1 - b), float(b**3)) for a, b in zip(y, s)], "y int, s double, flipped double, cubed double")
    m = evaluate.evaluate(df, "y", "s").first()
    assert np.isclose(m["roc_auc"], numpy_auc(y, s)) and np.isclose(m["gini"], 2 * m["roc_auc"] - 1)
    ks = 100 * max(abs((s[y == 1] <= t).mean() - (s[y == 0] <= t).mean()) for t in s)
    assert np.isclose(m["ks_statistic"], ks)
    assert np.isclose(evaluate.evaluate(df, "y", "flipped").first()["roc_auc"], 1 - m["roc_auc"])
    cubed = evaluate.evaluate(df, "y", "cubed").first()
    assert np.isclose(cubed["roc_auc"], m["roc_auc"]) and np.isclose(cubed["ks_statistic"], ks)
    assert np.isclose(m["brier_score"], np.mean((s - y) ** 2))


def test_ties_and_one_class(spark):
    tied = spark.createDataFrame([(i, i % 2, 0.5) for i in range(10)], "id int, y int, s double")
    m = evaluate.evaluate(tied, "y", "s").first()
    assert m["roc_auc"] == 0.5 and m["ks_statistic"] == 0.0
    assert rows(evaluate.roc_curve(tied, "y", "s"), "fpr", "tpr") == [(0.0, 0.0), (1.0, 1.0)]
    one = tied.withColumn("y", F.lit(1))
    assert evaluate.evaluate(one, "y", "s").first()["roc_auc"] is None
    assert all(r["lift"] == 1.0 for r in evaluate.lift(one, "y", "s", "id").collect())
    none = tied.withColumn("y", F.lit(0))
    assert all(r["lift"] == 1.0 for r in evaluate.lift(none, "y", "s", "id").collect())
    assert all(r["percentage_captured"] is None for r in evaluate.gains(none, "y", "s", "id").collect())


def test_fewer_rows_than_bins(spark):
    df = spark.createDataFrame([(i, i % 2, i / 10) for i in range(4)], "id int, y int, s double")
    got = evaluate.lift(df, "y", "s", "id").orderBy("decile").collect()
    assert [r["lift"] for r in got] == [None] * 9 + [1.0]
    gains = [r["percentage_captured"] for r in evaluate.gains(df, "y", "s", "id").orderBy("point").collect()]
    assert gains == sorted(gains) and gains[0] == 0.0 and gains[-1] == 1.0


def test_straight_roc_points_are_dropped(spark):
    df = spark.createDataFrame([(y, s) for s, ys in ((0.9, (1, 0)), (0.8, (1, 0)), (0.7, (1, 0)), (0.6, (0, 0)), (0.5, (1, 0))) for y in ys], "y int, s double")
    kept = sorted(t for (t,) in rows(evaluate.roc_curve(df, "y", "s"), "threshold"))
    assert kept == [0.5, 0.6, 0.7, 0.9, math.inf]
    assert evaluate.roc_curve(df, "y", "s", keep_all=True).count() == 6


def test_risk_flags(spark):
    def flags(*rows_):
        df = spark.createDataFrame(list(rows_), "model string, split string, roc_auc double")
        return rows(evaluate.risk_flags(df, ["a", "b"]), "flag", "model")

    assert flags(("a", "train", 0.9), ("a", "test", 0.85), ("b", "test", 0.8)) == [("none", None)]
    assert flags(("a", "train", 0.9), ("a", "test", 0.6), ("b", "train", 0.9), ("b", "test", 0.5)) == [("low_auc", "a"), ("overfit_gap", "a")]


# -- drift ------------------------------------------------------------------------

def numpy_psi(e, a, n_bins=10):
    edges = np.unique(np.percentile(e, np.linspace(0, 100, n_bins + 1)))
    share = lambda v: np.clip(np.bincount(np.digitize(v, edges[1:-1]), minlength=len(edges) - 1) / len(v), 1e-6, 1 - 1e-6)
    p, q = share(e), share(a)
    return float(np.sum((q - p) * np.log(q / p)))


@FEW
@given(st.integers(0, 1000), st.floats(0, 2))
def test_psi_against_numpy(spark, seed, shift):
    rng = np.random.default_rng(seed)
    e, a = np.round(rng.normal(size=200), 1), np.round(rng.normal(shift, 1, 150), 1)
    left = spark.createDataFrame([(float(v),) for v in e] + [(None,)], "v double")
    right = spark.createDataFrame([(float(v),) for v in a] + [(float("nan"),)], "v double")
    got = drift.psi(left, right, "v").first()["psi"]
    assert np.isclose(got, numpy_psi(e, a)) and got >= 0
    assert drift.psi(left, left, "v").first()["psi"] == 0


def test_binary_feature_drift_shows_by_category(spark):
    few = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("f"))
    most = spark.range(1000).select((F.col("id") % 10 != 0).cast("int").alias("f"))
    assert drift.psi_categorical(few, most, "f").first()["status"] == "significant_shift"
    flat = spark.range(50).select(F.lit(3.0).alias("f"))
    assert drift.psi(flat, flat, "f").first()["psi"] == 0


def test_empty_current_and_missing_columns(spark):
    base = spark.range(100).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    assert [r["feature"] for r in drift.psi_matrix(base, base.drop("b")).collect()] == ["a"]
    with pytest.raises(ValueError):
        drift.csi_feature(base, base.drop("b"), "b")
    baseline = drift.fit_baseline(base)
    empty = base.limit(0)
    assert rows(drift.psi_against(baseline, empty), "feature", "psi", "status", "n_rows") == [("a", None, None, 0), ("b", None, None, 0)]


def test_drift_threshold_zero_is_zero(spark):
    base = spark.range(100).select(F.col("id").cast("double").alias("a"))
    scores = drift.psi_against(drift.fit_baseline(base), base)
    assert drift.drifting_features(scores, 0).count() == 1 and drift.drifting_features(scores).count() == 0


def test_monitor_goes_on_after_a_reset(spark, tmp_path):
    near, far = (spark.range(100).select((F.col("id") + d).alias("a")) for d in (0, 500))
    path = str(tmp_path / "monitor")
    monitor = drift.DriftMonitor(spark, drift.fit_baseline(near), path)
    monitor.check(far, "2024-01-01")
    assert monitor.is_drifting() and drift.DriftMonitor(spark, path=path).is_drifting()
    monitor.reset_baseline(drift.fit_baseline(far))
    monitor.check(far, "2024-01-02")
    again = drift.DriftMonitor(spark, drift.fit_baseline(near), path)
    assert again.version == 2 and not again.is_drifting() and again.history().count() == 1
    with pytest.raises(ValueError, match="no baseline"):
        drift.DriftMonitor(spark, path=str(tmp_path / "none"))


@pytest.mark.parametrize("bad", [(3, 1, None), (3, 1, float("nan")), (3, 2, 0.5), (3, None, 0.5)])
def test_rows_that_no_metric_can_use_are_an_error(spark, bad):
    good = [(i, i % 2, i / 40) for i in range(10, 40)]
    df = spark.createDataFrame([*good, bad], "id int, y int, s double")
    for run in (lambda d: evaluate.evaluate(d, "y", "s"), lambda d: evaluate.roc_curve(d, "y", "s"), lambda d: evaluate.ks_curve(d, "y", "s"),
                lambda d: evaluate.lift(d, "y", "s", "id"), lambda d: evaluate.gains(d, "y", "s", "id")):
        with pytest.raises(Exception, match="must (not be null|be 0 or 1)"):
            run(df).collect()
        assert run(df.filter("id > 3")).collect()
    assert sum(evaluate.unscored(df, "y", "s").first()[1:]) == 1


def test_dates_by_all_rows_and_many_formats(spark):
    dated = ["2024-01-05T10:20:30.123Z", "2024-01-05 10:20:30+02:00", "5 Jan 2024", "March 3, 2024", "2024-01", "20240105", "05/01/2024"]
    for text in dated:
        assert spark.range(1).select(profile.looks_like_date(F.lit(text))).first()[0], text
    for text in ("abc", "12", "1.5", "May be", "x" * 99, ""):
        assert not spark.range(1).select(profile.looks_like_date(F.lit(text))).first()[0], text
    late = spark.createDataFrame([("2024-01-05" if i < 100 else f"n{i % 9}",) for i in range(300)], "d string")
    assert profile.date_shares(late).first()["date_share"] == pytest.approx(1 / 3)


def test_monitor_without_checks(spark):
    monitor = drift.DriftMonitor(spark, drift.fit_baseline(spark.range(100).select(F.col("id").alias("a"))))
    assert monitor.trend().count() == 0 and monitor.is_drifting() is False


# -- ordered features -------------------------------------------------------------

def test_frames_deeper_than_a_block_and_ties(spark):
    df = spark.createDataFrame([("e", i // 2, i, float(i)) for i in range(40)], "e string, t int, id int, v double").repartition(5)
    got = timeframe.lags(df, ["e"], "t", "v", (12,), rows_per_block=5, tiebreak="id").orderBy("id").collect()
    assert [r["v_lag_12"] for r in got] == [None] * 12 + [float(i) for i in range(28)]


@pytest.mark.parametrize("block", [7, 1_000])
def test_frames_across_blocks(spark, block):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"e": ["hot"] * 90 + ["a"] * 10, "t": list(range(90)) + list(range(10)), "v": rng.normal(size=100)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = timeframe.rolling(timeframe.lags(df, ["e"], "t", "v", (1, 3), rows_per_block=block), ["e"], "t", "v", (3,), rows_per_block=block)
    got = got.toPandas().sort_values(["e", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["e", "t"]).reset_index(drop=True)
    g = want.groupby("e").v
    assert len(got) == 100
    assert np.allclose(got.v_lag_3, g.shift(3), equal_nan=True)
    assert np.allclose(got.v_avg_3, g.rolling(3, min_periods=1).mean().values)


def test_quantile_bins_match_qcut(spark):
    v = np.round(np.random.default_rng(4).normal(size=300), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, v double")
    got = [r["d"] for r in timeframe.quantile_bins(df, "v", "d").orderBy("id").collect()]
    assert got == list(pd.qcut(v, 10, labels=False, duplicates="drop"))


def test_nulls_among_the_facts_stay(spark):
    """A period without facts is filled; a null that was measured is not."""
    spine = timeframe.entity_spine(spark.createDataFrame([(1,)], "k int"), "2024-01-01", "2024-03-01")
    facts = spark.createDataFrame([(1, "2024-01-01", None, "a"), (1, "2024-02-01", 4.0, None)], "k int, period string, v double, s string")
    facts = facts.withColumn("period", F.col("period").cast("date"))
    got = timeframe.on_spine(spine, facts, ["k", "period"]).orderBy("period").select("v", "s").collect()
    assert [tuple(r) for r in got] == [(None, "a"), (4.0, None), (0.0, None)]
    assert [str(d) for d in timeframe.period_bounds(facts, "period")] == ["2024-01-01", "2024-02-01"]


def test_resets_at_the_same_time_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    base = [drift.fit_baseline(spark.range(50 + 10 * i).select(F.col("id").cast("double").alias("value"))) for i in range(4)]
    first = drift.DriftMonitor(spark, base[0], path=str(tmp_path))
    others = [drift.DriftMonitor(spark, path=str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda mb: mb[0].reset_baseline(mb[1]), zip(others, base)))
    assert first.version == 1 and sorted(m.version for m in others) == [2, 3, 4, 5]
    last = max(others, key=lambda m: m.version)
    again = drift.DriftMonitor(spark, path=str(tmp_path))
    assert again.version == 5 and again.baseline == last.baseline


def test_rows_without_score_can_be_left_out(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, None), ("b", 0, float("nan")), ("b", None, 0.5), ("b", 1, 0.4)], "g string, y int, s double")
    kept, left = evaluate.scored_only(df, "y", "s", ["g"])
    assert evaluate.evaluate(kept, "y", "s").first()["roc_auc"] == 1.0
    assert {r["g"]: (r["n"], r["n_unscored"], r["n_bad_labels"]) for r in left.collect()} == {"a": (3, 1, 0), "b": (3, 1, 1)}


@pytest.mark.parametrize("text, is_date", [
    ("2024-02-29", True), ("2023-02-29", False), ("2024-02-29 10:11", True), ("2024-02-29T10:11:12.123+02:00", True), ("2024-02-29 10:11:12", True),
    ("2024/12/01", True), ("31/12/2024", True), ("12/31/2024", True), ("31-12-2024", True), ("20241231", True), ("20241331", False), ("2024-12", True),
    ("7 Jan 2024", True), ("7 January 2024", True), ("Jan 7, 2024", True), ("7 Janus 2024", False), ("12345", False), ("2024-02-29 and more", False), ("", False)])
def test_dates_by_shape(spark, text, is_date):
    got = spark.createDataFrame([(text,)], "t string").select(profile.looks_like_date(F.col("t"))).first()[0]
    assert got is is_date
