"""Approximate nearest neighbours by an inverted multi-index, nearest being the largest inner product.

Vectors are cut into two halves, each quantised by its own codebook; a pair of centroids is a cell. For a
query the cells are met in falling order of the summed inner products of its halves with the two centroids,
by a heap over the two sorted lists. From the numbers of vectors in the cells and the spread of residuals
each query derives what score its k-th neighbour should have and how many such neighbours each cell should
hold; it goes on until the cells met should hold ``reach`` of them. All vectors of these cells are reranked.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rows import local_table
from ..session import settle
from .common import per_batch

# Codebooks are fitted on a sample of expected SAMPLE vectors, at most twice that.
SAMPLE = 16_384
ROUNDS = 10
MOST_CENTROIDS = 256
ROWS_PER_CELL = 16
# Vectors of one centroid of the first half that a task holds at a time, and queries it scores together.
BLOCK_ROWS = 8_192
QUERIES_AT_ONCE = 256
REACH = 0.95


@dataclass
class Codebooks:
    """Centroids of both halves, the mean squared residual per dimension of each, and the vectors per cell."""

    halves: tuple[np.ndarray, np.ndarray]
    spread: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray

    @property
    def cut(self) -> int:
        return self.halves[0].shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_nearest(part, c) for part, c in zip((x[:, :self.cut], x[:, self.cut:]), self.halves))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2.0 * (x @ c.T), axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from sampled vectors, so dense regions get their share of centroids."""
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    at = _nearest(x, c)
    squared = ((x - c[at]) ** 2).mean(axis=1) if x.shape[1] else np.zeros(len(x))
    n = np.bincount(at, minlength=k)
    mean = squared.mean()
    # a centroid of few sampled vectors leans on the mean of all
    return c, (np.bincount(at, weights=squared, minlength=k) + 4 * mean) / (n + 4)


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): vectors that take part.

    Left out are null ids, null vectors, vectors with null or non-finite components, zero vectors and those
    whose length is not the commonest one (the shorter of two equally common ones). Other columns are dropped.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, ids, v): each different vector once, with its ``keep`` smallest ids; rep is the smallest of all.

    Copies score alike and ties go to smaller ids, so no further copy can be among ``keep`` neighbours.
    """
    same = W.partitionBy("h", "v").orderBy("id")
    first = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.dense_rank().over(same)).filter(F.col("r") <= keep)
    return first.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def fit(vectors: DataFrame, n: int, seed: int = 42) -> Codebooks:
    """Codebooks from a sample of ``vectors`` (rep, v), chosen by hash; ``n`` is their number. Cells are not counted yet."""
    share = min(1.0, SAMPLE / n)
    chosen = vectors.select("v", F.xxhash64("v", F.lit(seed)).alias("o")).filter(
        F.pmod(F.col("o"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).orderBy("o").limit(2 * SAMPLE)
    x = np.array([r["v"] for r in chosen.select("v").collect()], dtype=np.float64)
    k = max(1, min(round(math.sqrt(n / ROWS_PER_CELL)), MOST_CENTROIDS, len(x)))
    rng = np.random.default_rng(seed)
    cut = (x.shape[1] + 1) // 2
    (a, sa), (b, sb) = _k_means(x[:, :cut], k, rng), _k_means(x[:, cut:], k, rng)
    return Codebooks((a, b), (sa, sb), np.zeros((k, k), np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def route(books: Codebooks, q: np.ndarray, k: int, reach: float) -> list[tuple[int, list[int]]]:
    """Cells that a query visits, as (centroid of the first half, centroids of the second)."""
    cut, cells = books.cut, books.cells
    a, b = books.halves[0] @ q[:cut], books.halves[1] @ q[cut:]
    spread = np.sqrt((q[:cut] @ q[:cut]) * books.spread[0][:, None] + (q[cut:] @ q[cut:]) * books.spread[1][None, :]) + 1e-12
    held = cells > 0
    mean, dev, n = (a[:, None] + b[None, :])[held], spread[held], cells[held].astype(np.float64)
    lo, hi = (mean - 8 * dev).min(), (mean + 8 * dev).max()
    for _ in range(40):  # the score that k vectors should reach
        mid = (lo + hi) / 2
        if (n * _beyond((mid - mean) / dev)).sum() > k:
            lo = mid
        else:
            hi = mid
    expected = np.zeros(cells.shape)
    expected[held] = n * _beyond((lo - mean) / dev)
    wanted = reach * expected.sum()
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    order_a, order_b = ia.tolist(), ib.tolist()
    hits, count = expected[np.ix_(ia, ib)], cells[np.ix_(ia, ib)]
    visited: dict[int, list[int]] = {}
    heap = [(-(sa[0] + sb[0]), 0, 0)]
    got, seen, most = 0.0, 0, int(count.sum())
    least = min(k + 1, most)
    while heap and seen < most and (got < wanted or seen < least):
        _, i, j = heapq.heappop(heap)
        if c := int(count[i, j]):
            visited.setdefault(order_a[i], []).append(order_b[j])
            got += hits[i, j]
            seen += c
        if j + 1 < len(sb):
            heapq.heappush(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
    return list(visited.items())


def _beyond(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution beyond z, by a logistic form whose error is below 0.0002."""
    z = np.clip(z, -8, 8)
    return 1.0 / (1.0 + np.exp(z * (1.5976 + 0.07056 * z * z)))


def _best(scores: np.ndarray, exact, reps: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of a row, ties to smaller reps; ``exact`` rescores those near the k-th."""
    found = np.flatnonzero(scores > -np.inf)
    if len(found) > k:
        bar = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= bar - 1e-9 * max(1.0, abs(bar))]
    true = exact(found)
    order = np.lexsort((reps[found], -true))[:k]
    return found[order], true[order]


_HIT = T.StructType([T.StructField("q", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rep", T.LongType()),
                     T.StructField("ids", T.ArrayType(T.LongType()))])


def _rerank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (i, block, probe, rep, ids, v, js): the vectors of a block, then the queries that visit it."""
    key, held, block = None, [], None
    for batch in batches:
        i, b, probe = (batch.column(c).to_numpy() for c in range(3))
        change = np.flatnonzero((np.diff(i) != 0) | (np.diff(b) != 0) | (np.diff(probe) != 0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            if (int(i[lo]), int(b[lo])) != key:
                key, held, block = (int(i[lo]), int(b[lo])), [], None
            if not probe[lo]:
                held.append(part)
                continue
            if not held:
                continue
            block = block or _Block(held)
            for at in range(0, part.num_rows, QUERIES_AT_ONCE):
                yield block.score(part.slice(at, QUERIES_AT_ONCE), k)


class _Block:
    """Vectors of one centroid of the first half, by centroid of the second."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.reps = table.column("rep").to_numpy()
        self.ids = table.column("ids").combine_chunks()
        self.x = _matrix(table.column("v").combine_chunks())
        js = table.column("js").combine_chunks().flatten().to_numpy()
        self.at = {int(j): np.flatnonzero(js == j) for j in np.unique(js)}

    def score(self, probes: pa.RecordBatch, k: int) -> pa.RecordBatch:
        q = _matrix(probes.column(5))
        scores = np.full((len(q), len(self.x)), -np.inf)
        wanted: dict[int, list[int]] = {}
        for row, js in enumerate(probes.column(6).to_pylist()):
            for j in js:
                if j in self.at:
                    wanted.setdefault(j, []).append(row)
        for j, rows in wanted.items():
            cols = self.at[j]
            scores[np.ix_(rows, cols)] = q[rows] @ self.x[cols].T
        of, score, place = [], [], []
        for row, name in enumerate(probes.column(3).to_pylist()):
            found, true = _best(scores[row], lambda f, row=row: (self.x[f] * q[row]).sum(axis=1), self.reps, k)
            of += [name] * len(found)
            score.append(true)
            place.append(found)
        at = np.concatenate(place) if place else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(of, pa.int64()), pa.array(np.concatenate(score) if score else np.empty(0)), pa.array(self.reps[at], pa.int64()),
             self.ids.take(pa.array(at))], names=_HIT.names)


def search(vectors: DataFrame, is_query, k: int = 20, id: str = "vec_id", vector: str = "embedding", reach: float = REACH, seed: int = 42) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, ties to the smaller id.

    ``is_query`` is a condition on the column ``id`` as a long. Candidates are all usable vectors whose id is not the
    query's own, see ``usable``; fewer than k of them are all returned. Identical rows count once. Different vectors
    under one id are queries of their own, ranked each, and never neighbours of each other. Scores are exact inner products in
    double precision; which vectors are met is approximate.

    A vector that occurs often is indexed once with its k + 1 smallest ids and searched once for all queries
    that equal it. Vectors of a centroid of the first half are dealt into blocks of a bounded size, and
    each query goes once to every block it visits.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector)
    entries = settle(distinct_vectors(rows, k + 1), "vectors")
    n = entries.count()
    if not n:
        return local_table(spark, [], "query_id long, rank int, vec_id long, score double")
    books = fit(entries, n, seed)
    indexed = settle(_coded(entries, books), "index")
    for r in indexed.groupBy("i", "j").count().collect():  # at most MOST_CENTROIDS squared rows
        books.cells[r["i"], r["j"]] = r["count"]
    blocks = F.array(*[F.lit(math.ceil(max(int(c), 1) / BLOCK_ROWS)) for c in books.cells.sum(axis=1)])

    asked = rows.filter(is_query(F.col("id"))).select("id", F.xxhash64("v").alias("h"), "v").distinct()
    named = settle(asked.join(entries.select("rep", F.xxhash64("v").alias("h"), "v"), ["h", "v"]).select("id", "rep"), "queries")
    probes = _routed(entries.join(named.select("rep").distinct(), "rep"), books, k, reach)
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("i")] - 1)))
    shown = indexed.select(
        "i", F.pmod(F.xxhash64("rep"), blocks[F.col("i")]).cast("int").alias("block"), F.lit(0).alias("probe"), "rep", "ids", "v", F.array("j").alias("js"))
    asking = probes.select("i", "block", F.lit(1).alias("probe"), "rep", F.array().cast("array<bigint>").alias("ids"), "v", "js")
    met = shown.unionByName(asking).repartition("i", "block").sortWithinPartitions("i", "block", "probe")
    hits = met.mapInArrow(lambda batches: _rerank(batches, k + 1), _HIT)

    nearest = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = hits.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1)
    listed = best.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("groups")).select(
        F.col("q").alias("rep"),
        F.slice(F.array_sort(F.flatten(F.transform("groups", lambda g: F.transform(
            g["ids"], lambda x: F.struct((-g["score"]).alias("far"), x.alias("vec_id")))))), 1, 2 * k + 2).alias("near"))
    own = named.join(listed, "rep").select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("id")), 1, k).alias("near"))
    out = own.select("query_id", F.posexplode("near").alias("p", "e"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))


def _coded(entries: DataFrame, books: Codebooks) -> DataFrame:
    schema = T.StructType([*entries.schema.fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])

    def make():
        def of(batch: pa.RecordBatch) -> dict[str, object]:
            i, j = books.nearest(_matrix(batch.column(2)))
            return {"rep": batch.column(0), "ids": batch.column(1), "v": batch.column(2), "i": i.astype(np.int32), "j": j.astype(np.int32)}
        return of

    return per_batch(entries.select("rep", "ids", "v"), schema, make, rows=4_096)


def _routed(queries: DataFrame, books: Codebooks, k: int, reach: float) -> DataFrame:
    """(rep, v, i, js): for each query and centroid of the first half that it visits, those of the second."""
    schema = T.StructType([queries.schema["rep"], queries.schema["v"], T.StructField("i", T.IntegerType()),
                           T.StructField("js", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                batch = big.slice(lo, 64)
                at, i, js = [], [], []
                for row, q in enumerate(_matrix(batch.column(1))):
                    for first, second in route(books, q, k, reach):
                        at.append(row)
                        i.append(first)
                        js.append(second)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(i, pa.int32()), pa.array(js, pa.list_(pa.int32()))],
                    names=schema.names)

    return queries.select("rep", "v").mapInArrow(run, schema)
