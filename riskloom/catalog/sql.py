"""Text helpers for the SQL twins. They state each definition anew, from ranked rows and counts."""

from __future__ import annotations

from collections.abc import Sequence


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with no negative zero."""
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def long_form(source: str, cols: Sequence[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL" for c in cols)


def edge_ctes(name: str, source: str, cols: Sequence[str], k: int = 10) -> str:
    """CTEs ``<name>_edge`` (feature, i, e), ``<name>_uniq`` and ``<name>_inner`` (feature, j, e).

    Edge i sits at position i (n - 1) / k of the sorted values, between two of them by linear
    interpolation; inner edges are the distinct ones without the first and last.
    """
    return f"""
{name}_long AS ({long_form(source, cols)}),
{name}_rank AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS rn FROM {name}_long),
{name}_size AS (SELECT feature, count(*) AS n FROM {name}_long GROUP BY feature),
{name}_pos AS (SELECT feature, i, (i * (n - 1)) // {k} AS lo, ((i * (n - 1)) % {k}) / CAST({k} AS DOUBLE) AS frac
  FROM {name}_size, (SELECT unnest(range(0, {k + 1})) AS i)),
{name}_edge AS (SELECT p.feature, p.i, CASE WHEN p.frac = 0 THEN a.v ELSE a.v + (b.v - a.v) * p.frac END AS e
  FROM {name}_pos p JOIN {name}_rank a ON a.feature = p.feature AND a.rn = p.lo
  LEFT JOIN {name}_rank b ON b.feature = p.feature AND b.rn = p.lo + 1),
{name}_uniq AS (SELECT feature, e, row_number() OVER (PARTITION BY feature ORDER BY e) - 1 AS j,
  count(*) OVER (PARTITION BY feature) AS m FROM (SELECT DISTINCT feature, e FROM {name}_edge)),
{name}_inner AS (SELECT feature, j, e FROM {name}_uniq WHERE j BETWEEN 1 AND m - 2)"""


def quantile_cte(name: str, source: str, col: str, num: int, den: int) -> str:
    """CTE with one row: the num/den quantile ``q`` of a column."""
    return f"""
{name}_rank AS (SELECT CAST({col} AS DOUBLE) AS v, row_number() OVER (ORDER BY {col}) - 1 AS rn FROM {source} WHERE {col} IS NOT NULL),
{name}_pos AS (SELECT ({num} * (count(*) - 1)) // {den} AS lo, (({num} * (count(*) - 1)) % {den}) / CAST({den} AS DOUBLE) AS frac FROM {name}_rank),
{name} AS (SELECT CASE WHEN frac = 0 THEN a.v ELSE a.v + (b.v - a.v) * frac END AS q
  FROM {name}_pos JOIN {name}_rank a ON a.rn = lo LEFT JOIN {name}_rank b ON b.rn = lo + 1)"""


def psi_ctes(name: str, base: str, cur: str, cols: Sequence[str], inner: str, by: str | None = None) -> str:
    """CTE ``<name>_bins``: feature, bin (0-based), expected and actual share, contribution.

    ``inner`` names a CTE (feature, j, e) of inner edges. Every bin of the baseline has a row.
    """
    def binned(source, with_by):
        g = f"{by} AS g, " if with_by and by else "0 AS g, "
        rows = " UNION ALL ".join(
            f"SELECT {g}'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL" for c in cols)
        return f"""SELECT l.g, l.feature, (SELECT count(*) FROM {inner} u WHERE u.feature = l.feature AND u.e <= l.v) AS bin
  FROM ({rows}) l"""

    return f"""
{name}_eb AS ({binned(base, False)}),
{name}_ab AS ({binned(cur, True)}),
{name}_ec AS (SELECT feature, bin, count(*) AS c FROM {name}_eb GROUP BY feature, bin),
{name}_ac AS (SELECT g, feature, bin, count(*) AS c FROM {name}_ab GROUP BY g, feature, bin),
{name}_en AS (SELECT feature, count(*) AS n FROM {name}_eb GROUP BY feature),
{name}_an AS (SELECT g, feature, count(*) AS n FROM {name}_ab GROUP BY g, feature),
{name}_spine AS (SELECT feature, unnest(range(0, cnt + 1)) AS bin FROM (SELECT feature, count(*) AS cnt FROM {inner} GROUP BY feature)),
{name}_share AS (SELECT an.g, s.feature, s.bin,
  greatest(least(coalesce(ec.c, 0) / CAST(en.n AS DOUBLE), CAST(1 AS DOUBLE) - 1e-6), 1e-6) AS e,
  greatest(least(coalesce(ac.c, 0) / CAST(an.n AS DOUBLE), CAST(1 AS DOUBLE) - 1e-6), 1e-6) AS a
  FROM {name}_spine s JOIN {name}_en en ON en.feature = s.feature JOIN {name}_an an ON an.feature = s.feature
  LEFT JOIN {name}_ec ec ON ec.feature = s.feature AND ec.bin = s.bin
  LEFT JOIN {name}_ac ac ON ac.g = an.g AND ac.feature = s.feature AND ac.bin = s.bin),
{name}_bins AS (SELECT g, feature, bin, e, a, (a - e) * ln(a / e) AS part FROM {name}_share)"""


PSI_STATUS = "CASE WHEN {x} < 0.10 THEN 'stable' WHEN {x} < 0.25 THEN 'moderate_shift' ELSE 'significant_shift' END"


def psi_status(x: str) -> str:
    return PSI_STATUS.format(x=x)


def hash_rank(key: str, seed: int, stratum: str | None) -> str:
    """0-based rank of a row within its stratum by the md5 of key and seed."""
    part = f"PARTITION BY {stratum} " if stratum else ""
    return f"row_number() OVER ({part}ORDER BY md5(concat({key}, '|{seed}'))) - 1"
