"""Queries on drift: line items before and after 1998, and a month of events by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as I
from ..session import fresh_path
from ..streaming import drift as S
from .frames import BEFORE_AFTER, DRIFT_COLUMNS, before_after, first_week_events
from .registry import query, rounded, table
from .sql import big, edge_ctes, psi_ctes, psi_status, quantile_cte, r

_EDGES = edge_ctes("q", "before", DRIFT_COLUMNS)
_BINS = f"WITH {BEFORE_AFTER}, {_EDGES}, {psi_ctes('d', 'before', 'after', DRIFT_COLUMNS, 'q_inner')}"
_PSI = f"{_BINS}, psi AS (SELECT feature, sum(part) AS psi, count(*) AS n_bins FROM d_bins GROUP BY feature)"
_PSI_OUT = f"feature, {r('psi')} AS psi, {psi_status('psi')} AS status, CAST(n_bins AS INTEGER) AS n_bins"


def _scores(spark, folder):
    before, after = before_after(spark, folder)
    return I.psi_against(I.fit_baseline(before, DRIFT_COLUMNS), after)


@query("psi_quantile_bins", ["I1", "I4"], f"{_PSI} SELECT {_PSI_OUT} FROM psi WHERE feature = 'shifted'")
def psi_quantile_bins(spark, folder):
    before, after = before_after(spark, folder)
    return rounded(I.psi(before, after, "shifted").drop("n_rows"))


@query("psi_uniform_bins", ["I2"], f"""WITH {BEFORE_AFTER}, u AS (SELECT min(price) AS lo, max(price) AS hi FROM before),
u_inner AS (SELECT 'price' AS feature, i AS j, lo + (hi - lo) * i / CAST(10 AS DOUBLE) AS e FROM u, (SELECT unnest(range(1, 10)) AS i)),
{psi_ctes('d', 'before', 'after', ['price'], 'u_inner')}, psi AS (SELECT feature, sum(part) AS psi, count(*) AS n_bins FROM d_bins GROUP BY feature) SELECT {_PSI_OUT} FROM psi""")
def psi_uniform_bins(spark, folder):
    before, after = before_after(spark, folder)
    return rounded(I.psi(before, after, "price", strategy="uniform").drop("n_rows"))


@query("psi_few_values", ["I3"], f"""WITH {BEFORE_AFTER}, {quantile_cte('mid', 'before', 'is_returned', 1, 2)},
m_inner AS (SELECT 'is_returned' AS feature, 1 AS j, q AS e FROM mid), {psi_ctes('d', 'before', 'after', ['is_returned'], 'm_inner')},
psi AS (SELECT feature, sum(part) AS psi, count(*) AS n_bins FROM d_bins GROUP BY feature) SELECT {_PSI_OUT} FROM psi""")
def psi_few_values(spark, folder):
    """A 0/1 column has fewer than three edges: two bins, split at the median."""
    before, after = before_after(spark, folder)
    return rounded(I.psi(before, after, "is_returned").drop("n_rows"))


_DETAIL = f"""SELECT d.feature, CAST(d.bin + 1 AS INTEGER) AS bin, {r('lo.e')} AS lower, {r('hi.e')} AS upper, {r('d.e', 8)} AS expected_pct, {r('a', 8)} AS actual_pct,
{r('part', 8)} AS psi_contribution FROM d_bins d LEFT JOIN q_inner lo ON lo.feature = d.feature AND lo.j = d.bin LEFT JOIN q_inner hi ON hi.feature = d.feature AND hi.j = d.bin + 1"""


def _detail(df):
    return df.withColumns({c: F.round(c, 6 if c in ("lower", "upper") else 8) for c, t in df.dtypes if t == "double"})


@query("psi_bin_details", ["I5"], f"{_BINS} {_DETAIL}")
def psi_bin_details(spark, folder):
    before, after = before_after(spark, folder)
    return _detail(I.psi_against(I.fit_baseline(before, DRIFT_COLUMNS), after, details=True))


@query("frozen_baseline", ["I6"], f"""{_BINS} SELECT feature, CAST(bin AS INTEGER) AS bin, {r('e', 8)} AS expected FROM d_bins""")
def frozen_baseline(spark, folder):
    """Saved, loaded, and unfolded."""
    before, _ = before_after(spark, folder)
    path = fresh_path(spark, "baseline")
    I.fit_baseline(before, DRIFT_COLUMNS).save(spark, path)
    out = I.Baseline.load(spark, path).table(spark).select("feature", F.posexplode("expected").alias("bin", "expected"))
    return rounded(out, 8)


# -- windows over events ----------------------------------------------------------

_WEEK = "week AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-08'), daily AS (SELECT value, date_trunc('day', ts) AS day FROM events)"
_DAILY = f"""WITH {_WEEK}, {edge_ctes('q', 'week', ['value'])}, {psi_ctes('d', 'week', 'daily', ['value'], 'q_inner', 'day')},
psi AS (SELECT CAST(g AS DATE) AS day, feature, sum(part) AS psi FROM d_bins GROUP BY g, feature)"""


def _day(df):
    return rounded(df.select(F.col("window_start").cast("date").alias("day"), "feature", "psi", "status"))


@query("psi_by_day", ["I8", "I19"], f"{_DAILY} SELECT day, feature, {r('psi')} AS psi, {psi_status('psi')} AS status FROM psi")
def psi_by_day(spark, folder):
    baseline = I.fit_baseline(first_week_events(spark, folder))
    return _day(I.psi_by_window(table(spark, folder, "events"), baseline, "ts", "1 day"))


@query("psi_by_sliding_window", ["I19"], f"""WITH {_WEEK}, slid AS (SELECT value, CAST(day AS DATE) + CAST(-k AS INTEGER) AS start FROM daily, (SELECT unnest(range(0, 7)) AS k)),
{edge_ctes('q', 'week', ['value'])}, {psi_ctes('d', 'week', 'slid', ['value'], 'q_inner', 'start')},
psi AS (SELECT CAST(g AS DATE) AS day, feature, sum(part) AS psi FROM d_bins GROUP BY g, feature)
SELECT day, feature, {r('psi')} AS psi, {psi_status('psi')} AS status FROM psi""")
def psi_by_sliding_window(spark, folder):
    baseline = I.fit_baseline(first_week_events(spark, folder))
    return _day(I.psi_by_window(table(spark, folder, "events"), baseline, "ts", "7 days", "1 day"))


@query("streaming_psi_by_day", ["I19"], f"{_DAILY} SELECT day, feature, {r('psi')} AS psi, {psi_status('psi')} AS status FROM psi")
def streaming_psi_by_day(spark, folder):
    """The same as a stream in update mode: the count log holds open windows too."""
    baseline = I.fit_baseline(first_week_events(spark, folder))
    log, mark = fresh_path(spark, "count-log"), fresh_path(spark, "stream")
    S.start_count_log(S.file_stream(spark, folder, "events.parquet"), baseline, "ts", "1 day", log, mark).awaitTermination()
    return _day(S.logged_psi(spark, log, baseline))


@query("streaming_psi_closed_days", ["I19"], f"""{_DAILY} SELECT day, feature, {r('psi')} AS psi, {psi_status('psi')} AS status FROM psi
WHERE day < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events)""")
def streaming_psi_closed_days(spark, folder):
    """Append mode: a day appears once the watermark has passed its end."""
    baseline = I.fit_baseline(first_week_events(spark, folder))
    out, mark = fresh_path(spark, "closed-days"), fresh_path(spark, "stream")
    rows = S.closed_window_psi(S.file_stream(spark, folder, "events.parquet"), baseline, "ts", "1 day")
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
        availableNow=True).start().awaitTermination()
    return _day(spark.read.parquet(out))


# -- monitors ---------------------------------------------------------------------

def _thirds(spark, folder):
    ev = table(spark, folder, "events")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    upto = lambda d: F.col("ts") < at(d) if d else F.lit(True)  # noqa: E731  the last part has no end
    return [(end, ev.filter((F.col("ts") >= at(a)) & upto(b)).select("value"))
            for a, b, end in (("2024-01-08", "2024-01-16", "2024-01-16 00:00:00"), ("2024-01-16", "2024-01-24", "2024-01-24 00:00:00"),
                              ("2024-01-24", None, "2024-02-01 00:00:00"))]


_CHECKS = f"""WITH {_WEEK}, parts AS (SELECT value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END AS part
FROM events WHERE ts >= TIMESTAMP '2024-01-08'), {edge_ctes('q', 'week', ['value'])}, {psi_ctes('d', 'week', 'parts', ['value'], 'q_inner', 'part')},
psi AS (SELECT g AS part, feature, sum(part) AS psi FROM d_bins GROUP BY g, feature)"""


def _checked(spark, folder, **kw):
    monitor = I.DriftMonitor(spark, I.fit_baseline(first_week_events(spark, folder)), **kw)
    for end, part in _thirds(spark, folder):
        monitor.check(part, end)
    return monitor


@query("monitor_history", ["I7", "I8", "I16"], f"{_CHECKS} SELECT CAST(row_number() OVER (ORDER BY part) AS INTEGER) AS nth, feature, {r('psi')} AS psi, {psi_status('psi')} AS status FROM psi")
def monitor_history(spark, folder):
    from pyspark.sql import Window

    trend = _checked(spark, folder).trend("value")
    nth = F.row_number().over(Window.partitionBy("feature").orderBy("checked_at"))
    return rounded(trend.select(nth.alias("nth"), "feature", "psi", "status"))


@query("monitor_is_drifting", ["I9"], f"{_CHECKS} SELECT {r('psi')} AS latest_psi, psi >= 0.002 AS is_drifting FROM psi ORDER BY part DESC LIMIT 1")
def monitor_is_drifting(spark, folder):
    monitor = _checked(spark, folder, alert_threshold=0.002)
    return rounded(monitor.latest().select(F.col("psi").alias("latest_psi"), F.lit(monitor.is_drifting()).alias("is_drifting")))


@query("monitor_reset", ["I10", "I18"], f"""WITH parts AS (SELECT value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END AS part
FROM events WHERE ts >= TIMESTAMP '2024-01-08'), base AS (SELECT value FROM parts WHERE part = 1), last AS (SELECT value FROM parts WHERE part = 3),
{edge_ctes('q', 'base', ['value'])}, {psi_ctes('d', 'base', 'last', ['value'], 'q_inner')}
SELECT CAST(2 AS INTEGER) AS baseline_version, {big('1')} AS n_checks, {r('sum(part)')} AS psi FROM d_bins""")
def monitor_reset(spark, folder):
    """A new baseline starts a history of its own."""
    monitor = _checked(spark, folder)
    (_, first), _, (end, last) = _thirds(spark, folder)
    monitor.reset_baseline(I.fit_baseline(first))
    monitor.check(last, end)
    return rounded(monitor.history().groupBy("baseline_version").agg(F.count(F.lit(1)).alias("n_checks"), F.max("psi").alias("psi")))


@query("monitor_reopened", ["I9", "I10", "I18"], f"""WITH parts AS (SELECT value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END AS part
FROM events WHERE ts >= TIMESTAMP '2024-01-08'), base AS (SELECT value FROM parts WHERE part = 1), last AS (SELECT value FROM parts WHERE part = 3),
{edge_ctes('q', 'base', ['value'])}, {psi_ctes('d', 'base', 'last', ['value'], 'q_inner')}
SELECT CAST(2 AS INTEGER) AS baseline_version, {big('1')} AS n_checks, {r('sum(part)')} AS psi, false AS is_drifting FROM d_bins""")
def monitor_reopened(spark, folder):
    """A monitor opened on the path of another goes on with its newest baseline and that baseline's checks."""
    monitor = _checked(spark, folder)
    (_, first), _, (end, last) = _thirds(spark, folder)
    monitor.reset_baseline(I.fit_baseline(first))
    monitor.check(last, end)
    again = I.DriftMonitor(spark, path=monitor.root)
    rows = again.history().groupBy("baseline_version").agg(F.count(F.lit(1)).alias("n_checks"), F.max("psi").alias("psi"))
    return rounded(rows.withColumn("is_drifting", F.lit(again.is_drifting())))


# -- many features ----------------------------------------------------------------

@query("psi_matrix", ["I11"], f"{_PSI} SELECT {_PSI_OUT} FROM psi")
def psi_matrix(spark, folder):
    before, after = before_after(spark, folder)
    return rounded(I.psi_matrix(before, after.drop("is_returned"), [*DRIFT_COLUMNS, "is_returned"]).drop("n_rows"))


@query("csi_overall", ["I12"], f"""{_PSI} SELECT CASE WHEN count(*) FILTER (psi >= 0.25) / 5.0 >= 0.2 OR count(*) FILTER (psi >= 0.25) >= 5 THEN 'alert'
WHEN count(*) FILTER (psi >= 0.25) >= 1 THEN 'warning' ELSE 'stable' END AS overall_status, {big('count(*)')} AS n_features,
{big('count(*) FILTER (psi >= 0.25)')} AS n_drifting, coalesce(string_agg(CASE WHEN psi >= 0.25 THEN feature END, ',' ORDER BY feature), '') AS drifting_features FROM psi""")
def csi_overall(spark, folder):
    out = I.csi_overall(_scores(spark, folder), len(DRIFT_COLUMNS))
    return out.withColumn("drifting_features", F.concat_ws(",", "drifting_features"))


@query("csi_one_feature", ["I13"], f"{_PSI} SELECT {_PSI_OUT} FROM psi WHERE feature = 'discount'")
def csi_one_feature(spark, folder):
    before, after = before_after(spark, folder)
    return rounded(I.csi_feature(before, after, "discount").drop("n_rows"))


@query("drifting_features", ["I14"], f"{_PSI} SELECT feature FROM psi WHERE psi >= 0.1")
def drifting_features(spark, folder):
    return I.drifting_features(_scores(spark, folder), 0.1)


@query("csi_summary", ["I15"], f"{_PSI} SELECT feature, {r('psi')} AS csi, {psi_status('psi')} AS status, psi >= 0.25 AS is_drifting FROM psi")
def csi_summary(spark, folder):
    return rounded(I.csi_summary(_scores(spark, folder)))


def _stat_rows():
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, (SELECT avg({c}) FROM before) AS bm, (SELECT avg({c}) FROM after) AS cm,
(SELECT stddev_samp({c}) FROM before) AS bs, (SELECT stddev_samp({c}) FROM after) AS cs,
(SELECT 100 - 100.0 * count({c}) / count(*) FROM before) AS bn, (SELECT 100 - 100.0 * count({c}) / count(*) FROM after) AS cn""" for c in DRIFT_COLUMNS)


@query("drift_report", ["I17"], f"""{_PSI}, st AS ({_stat_rows()})
SELECT psi.feature, {r('psi')} AS csi, {psi_status('psi')} AS status, {r('bm')} AS baseline_mean, {r('cm')} AS current_mean, {r('cm - bm')} AS mean_shift,
{r('bs')} AS baseline_std, {r('cs')} AS current_std, {r('cs / greatest(bs, 1e-8)')} AS std_ratio, {r('bn')} AS baseline_missing_pct, {r('cn')} AS current_missing_pct
FROM psi JOIN st ON st.feature = psi.feature""")
def drift_report(spark, folder):
    before, after = before_after(spark, folder)
    return rounded(I.drift_report(before, after, DRIFT_COLUMNS))


@query("psi_categorical", ["I20"], f"""WITH {BEFORE_AFTER}, b AS (SELECT mode AS k, count(*) AS n FROM before GROUP BY 1), a AS (SELECT mode AS k, count(*) AS n FROM after GROUP BY 1),
s AS (SELECT greatest(least(coalesce(b.n, 0) / CAST((SELECT count(*) FROM before) AS DOUBLE), CAST(1 AS DOUBLE) - 1e-6), 1e-6) AS e,
greatest(least(coalesce(a.n, 0) / CAST((SELECT count(*) FROM after) AS DOUBLE), CAST(1 AS DOUBLE) - 1e-6), 1e-6) AS x FROM b FULL JOIN a ON a.k = b.k)
SELECT 'mode' AS feature, {r('sum((x - e) * ln(x / e))')} AS psi, {psi_status('sum((x - e) * ln(x / e))')} AS status, {big('count(*)')} AS n_categories FROM s""")
def psi_categorical(spark, folder):
    before, after = before_after(spark, folder)
    return rounded(I.psi_categorical(before, after, "mode"))
