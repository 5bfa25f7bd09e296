"""Exact-size deterministic splits by hash thresholds.

Each row gets ``md5(key|seed)``. Cutting a stratum at rank r means finding the r-th
smallest hash; that is a radix selection on hex digits, whose rounds are small
aggregates. Assigning a row is then a comparison with a handful of literals: no sort,
no shuffle and no join of the data, and the same answer on every retry.

Of a few strata the driver holds the digit counts and the thresholds. Of more the same selection
runs on tables of (stratum, digits, count) that windows narrow, and the thresholds are a table that
is attached to the rows; the driver then holds nothing per stratum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .rows import attach, join_null_safe, local_table

DIGITS = 3
ROWS_PER_TASK = 1_000_000
# Strata whose counts, at most 16 ** DIGITS each, the driver holds.
DRIVER_STRATA = 64

_HASH = "__hash"


def row_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


@dataclass(frozen=True)
class Ranks:
    """Cut ranks in a stratum of n rows: n x share, rounded down, or half up."""

    shares: Sequence[Fraction]
    half_up: bool = False

    def __call__(self, n: int) -> list[int]:
        return [(2 * n * s.numerator + self.half_up * s.denominator) // (2 * s.denominator) for s in self.shares]

    def of(self, n: str) -> list[Column]:
        return [F.expr(f"(2 * {n} * {s.numerator}L + {int(self.half_up) * s.denominator}L) div {2 * s.denominator}L") for s in self.shares]


@dataclass
class CutTable:
    """(s, n, cuts): of each stratum that has any, its rows and hash thresholds; ``rows`` strata."""

    table: DataFrame
    rows: int


def hash_cuts(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    stratum: Column,
    cuts: Ranks | Callable[[int], Sequence[int]],
    *,
    rows_per_task: int = ROWS_PER_TASK,
    driver_strata: int = DRIVER_STRATA,
) -> dict | CutTable:
    """``{stratum: (rows, [hash threshold per cut])}``, or for more than ``driver_strata`` strata a table of these.

    ``cuts(n)`` names the ranks; a row lies before a cut when its hash is below the
    threshold. None means every row does. Any number of strata needs ``Ranks``.
    """
    hashed = df.select(stratum.cast("string").alias("s"), row_hash(keys, seed).alias("h"))
    first = hashed.groupBy("s", F.substring("h", 1, DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = first.limit(driver_strata * 16**DIGITS + 1).collect()
    by_stratum: dict = {}
    for r in rows:
        by_stratum.setdefault(r["s"], {})[r["p"]] = r["n"]
    if len(by_stratum) > driver_strata:
        if not isinstance(cuts, Ranks):
            raise ValueError(f"more than {driver_strata} strata: give the cuts as Ranks")
        return _cuts_by_table(df, keys, seed, stratum, cuts, rows_per_task)

    sizes = {s: sum(c.values()) for s, c in by_stratum.items()}
    found: dict = {s: [None] * len(cuts(n)) for s, n in sizes.items()}
    todo = []
    for s, counts in by_stratum.items():
        for i, rank in enumerate(cuts(sizes[s])):
            if rank < sizes[s]:
                todo.append(_descend(s, i, "", rank, counts))
    depth = DIGITS
    while any(t[4] > rows_per_task for t in todo) and depth + DIGITS <= 30:
        depth += DIGITS
        spots = local_table(df.sparkSession, sorted({(t[0], t[2]) for t in todo if t[4] > rows_per_task}, key=str), "s string, p string")
        inner = join_null_safe(hashed.withColumn("p", F.substring("h", 1, depth - DIGITS)), spots, ["s", "p"], "inner", True)
        finer: dict = {}
        for r in inner.groupBy("s", "p", F.substring("h", 1, depth).alias("q")).agg(F.count(F.lit(1)).alias("n")).collect():
            finer.setdefault((r["s"], r["p"]), {})[r["q"]] = r["n"]
        nxt = []
        for t in todo:
            nxt.append(_descend(t[0], t[1], t[2], t[3], finer[(t[0], t[2])]) if t[4] > rows_per_task else t)
        todo = nxt
    for width in sorted({len(t[2]) for t in todo}):
        here = [t for t in todo if len(t[2]) == width]
        asked = local_table(df.sparkSession, [(t[0], t[2], t[1], t[3] + 1) for t in here], "s string, p string, i int, k bigint")
        spots = asked.select("s", "p").distinct()
        inner = join_null_safe(hashed.withColumn("p", F.substring("h", 1, width)), spots, ["s", "p"], "inner", True)
        ranked = inner.withColumn("rn", F.row_number().over(Window.partitionBy("s", "p").orderBy("h")))
        hits = join_null_safe(ranked.withColumnRenamed("rn", "k"), asked, ["s", "p", "k"], "inner", True)
        for r in hits.select("s", "i", "h").collect():
            found[r["s"]][r["i"]] = r["h"]
    return {s: (sizes[s], found[s]) for s in sizes}


def _descend(s, i, prefix, rank, counts):
    """Step into the digit group that holds ``rank``: (stratum, cut, prefix, rank within, rows)."""
    seen = 0
    for p in sorted(counts):
        if rank < seen + counts[p]:
            return (s, i, p, rank - seen, counts[p])
        seen += counts[p]
    raise AssertionError(f"rank {rank} lies beyond {prefix or 'the stratum'}")


def _named(stratum: Column) -> Column:
    """A stratum as a key that joins, null included."""
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))


def _cuts_by_table(df: DataFrame, keys: Sequence[str], seed: int, stratum: Column, cuts: Ranks, rows_per_task: int) -> CutTable:
    """The selection of ``hash_cuts`` on Spark. A spot is (s, i, p, k, n): cut i of stratum s is the k-th of the n hashes that begin with p."""
    hashed = df.select(_named(stratum).alias("s"), row_hash(keys, seed).alias("h"))
    first = hashed.groupBy("s", F.substring("h", 1, DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("s")
    counted = first.withColumns({"total": F.sum("n").over(whole), "before": F.sum("n").over(whole.orderBy("p")) - F.col("n")})
    asked = counted.select("s", "p", "n", "total", "before", F.posexplode(F.array(*cuts.of("total"))).alias("i", "rank"))
    spots = settle(_stepped(asked).select("s", "i", "p", "k", "n", "total"), "cuts")
    found, depth = [], DIGITS
    while True:
        last = depth + DIGITS > 30
        small = spots if last else spots.filter(F.col("n") <= rows_per_task)
        found.append(_thresholds(hashed, small, depth))
        if last or spots.filter(F.col("n") > rows_per_task).isEmpty():
            break
        large = spots.filter(F.col("n") > rows_per_task).withColumnRenamed("n", "held")
        inner = hashed.withColumn("p", F.substring("h", 1, depth)).join(large.select("s", "p").distinct(), ["s", "p"])
        finer = inner.groupBy("s", "p", F.substring("h", 1, depth + DIGITS).alias("q")).agg(F.count(F.lit(1)).alias("n"))
        here = Window.partitionBy("s", "p").orderBy("q")
        finer = finer.withColumn("before", F.sum("n").over(here) - F.col("n"))
        inside = large.join(finer, ["s", "p"]).select("s", "i", F.col("q").alias("p"), F.col("k").alias("rank"), "before", "n", "total")
        spots = settle(_stepped(inside).select("s", "i", "p", "k", "n", "total"), "cuts")
        depth += DIGITS
    table = reduce(DataFrame.unionByName, found).groupBy("s").agg(F.max("total").alias("n"), F.collect_list("h").alias("cuts"))
    table = settle(table, "cuts")
    return CutTable(table, table.count())


def _stepped(cells: DataFrame) -> DataFrame:
    """The cells that hold their rank, with the rank within the cell."""
    return cells.filter("rank >= before AND rank < before + n").withColumn("k", F.col("rank") - F.col("before"))


def _thresholds(hashed: DataFrame, spots: DataFrame, depth: int) -> DataFrame:
    """(s, total, h): the hash at each spot; a spot has at most rows_per_task hashes."""
    inner = hashed.withColumn("p", F.substring("h", 1, depth)).join(spots.select("s", "p").distinct(), ["s", "p"])
    ranked = inner.withColumn("k", F.row_number().over(Window.partitionBy("s", "p").orderBy("h")).cast("long") - 1)
    return ranked.join(spots.select("s", "i", "p", "k", "total"), ["s", "p", "k"]).select("s", "total", "h")


def assign_blocks(df: DataFrame, keys: Sequence[str], seed: int, stratum: Column, cuts: dict | CutTable, out: str) -> DataFrame:
    """Add the 0-based block of each row: how many of its stratum's cuts lie at or below its hash."""
    if isinstance(cuts, CutTable):
        table = cuts.table.select(F.col("s").alias("__s"), F.col("n").alias("__n"), F.col("cuts").alias("__cuts"))
        held = attach(df.withColumn("__s", _named(stratum)), table, ["__s"], table_rows=cuts.rows, weight="__n").withColumn(_HASH, row_hash(keys, seed))
        below = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<string>")), lambda t: t <= F.col(_HASH)))
        return held.withColumn(out, below).drop("__s", "__cuts", _HASH)
    block = F.lit(0)
    if cuts:
        block = None
        for s, (_n, thresholds) in cuts.items():
            at = F.lit(0)
            for t in thresholds:
                if t is not None:
                    at = at + (F.col(_HASH) >= F.lit(t)).cast("int")
            here = stratum.cast("string").eqNullSafe(F.lit(s))
            block = F.when(here, at) if block is None else block.when(here, at)
    # a column of its own, so that the hash is computed once per row and not once per cut
    return df.withColumn(_HASH, row_hash(keys, seed)).withColumn(out, block).drop(_HASH)
