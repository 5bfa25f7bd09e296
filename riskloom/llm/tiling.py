"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``seed`` tokens are compared by repeatedly
marking their longest matches that overlap no earlier one, found by running Karp-Rabin hashes at
falling search lengths. Tiles may come in any order, so an item whose sentences were rearranged is
still covered.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .common import U64, per_batch, windows, word_hashes

SEED = 5
COVERAGE = 0.5
BROADCAST_CHARS = 1_000_000  # a benchmark of more characters is joined instead of sent to the tasks
BITS = 27  # of a seed's hash that tell apart, in a bitmap of 16 MB, the seeds which no item has
_TOKEN = re.compile(r"\w+")
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2 ** 64
_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_FOUND = "item_tokens long, covered long, n_tiles long, longest long, coverage double"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-case runs of letters, digits and underscores."""
    return word_hashes(_TOKEN.findall(text.lower())) if text else np.empty(0, U64)


class _Side:
    """Tokens of one side, those still unmarked, and the running hashes of their runs."""

    def __init__(self, values: np.ndarray, free: np.ndarray):
        n = len(values)
        self.values, self.free = values, free
        powers = np.cumprod(np.full(n, _BASE, U64))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * powers)])
        self.back = np.cumprod(np.full(n, _BACK, U64))

    def look(self) -> int:
        """Count the unmarked tokens from each place on; the most there are."""
        n = len(self.free)
        stop = np.where(self.free, n, np.arange(n))
        self.ahead = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
        return int(self.ahead.max(initial=0))

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``length`` unmarked tokens."""
        at = np.flatnonzero(self.ahead >= length)
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]

    def whole(self, at: int, length: int) -> bool:
        """Whether nothing marked at this length reaches into the run: a mark would hold one of its ends."""
        return bool(self.free[at] and self.free[at + length - 1])


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` occur in ``b``."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _covers(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n tokens lie in a run of ``size`` that begins at a marked start."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:n]) > 0


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED, need: float = 0) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles of at least ``least`` tokens, longest first.

    The longest length at which unmarked tokens of both sides agree is searched by halving, as a match holds
    matches of every smaller length. All its non-overlapping matches are marked, in order of item, then document
    start, so the next length is smaller. Hashes only propose: tokens are compared before they are marked.
    No tile is sought where the runs of ``least`` tokens both share cover fewer than ``need`` of the item.
    """
    n, least = len(item), min(least, len(item))
    if not least or len(doc) < least:
        return []
    of_item, of_doc = windows(item, least), windows(doc, least)
    in_doc = _shared(of_item, of_doc)
    held = _covers(in_doc, n, least)
    if not in_doc.any() or held.sum() < need:
        return []
    # Only stretches that both share can hold a tile, so a long document costs what it shares.
    there = _covers(_shared(of_doc, of_item), len(doc), least)
    kept = np.flatnonzero(there)
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    kept = np.insert(kept, gaps, -1)
    x, y = _Side(item, held), _Side(np.where(kept >= 0, doc[kept], U64(0)), kept >= 0)
    tiles: list[tuple[int, int, int]] = []
    top = n
    while True:
        top = min(top, x.look(), y.look())
        low, high = least - 1, top  # runs of ``low`` agree, longer ones than ``high`` do not
        while low < high:
            middle = (low + high + 1) // 2
            if _shared(x.runs(middle)[1], y.runs(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            return tiles
        tiles += [(i, int(kept[j]), low) for i, j in _mark(x, y, low)]
        top = low - 1


def _mark(x: _Side, y: _Side, length: int) -> list[tuple[int, int]]:
    """Mark the matches of ``length`` in order. A start that was overlapped stays so, hence each is passed once."""
    (xs, hx), (ys, hy) = x.runs(length), y.runs(length)
    mine, theirs = _shared(hx, hy), _shared(hy, hx)
    places: dict[int, list[int]] = defaultdict(list)
    for j, h in zip(ys[theirs].tolist(), hy[theirs].tolist()):
        places[h].append(j)
    passed: dict[int, int] = defaultdict(int)
    out = []
    for i, h in zip(xs[mine].tolist(), hx[mine].tolist()):
        if not x.whole(i, length):
            continue
        js, at = places[h], passed[h]
        while at < len(js) and not y.whole(js[at], length):
            at += 1
        passed[h] = at
        for j in js[at:]:
            if y.whole(j, length) and np.array_equal(x.values[i : i + length], y.values[j : j + length]):
                x.free[i : i + length] = False
                y.free[j : j + length] = False
                out.append((i, j))
                break
    return out


def _measure(item: np.ndarray, doc: np.ndarray, seed: int, coverage: float):
    """The columns of _FOUND, or None if too little of the item is covered."""
    tiles = tile(item, doc, seed, coverage * len(item))
    covered = sum(t[2] for t in tiles)
    if not covered or covered < coverage * len(item):
        return None
    return len(item), covered, len(tiles), max(t[2] for t in tiles), covered / len(item)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """doc_id, item_id, item_tokens, covered, n_tiles, longest, coverage of each pair covered enough.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A benchmark of at most
    ``broadcast_chars`` characters goes to the tasks and documents are not shuffled; a larger one meets them in a join
    of shared seeds, with the same result. An item of fewer than ``seed`` tokens must occur whole. Null, empty and
    token-less texts match nothing. Repeated documents return a row each; repeated items count once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    if size > broadcast_chars:
        return _joined(rows, items, seed, coverage)
    block = [tuple(r) for r in items.orderBy("item_id", "text").collect()]
    return per_batch(rows, f"doc_id long, item_id long, {_FOUND}", lambda: _matcher(block, seed, coverage))


def _index(block: list[tuple[int | None, str]], seed: int):
    """Sorted seed hashes of the items, the item of each, and the items' tokens."""
    items = [tokens(text) for _, text in block]
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {min(seed, len(t)) for t in items if len(t)}:
        own = [(i, np.unique(windows(t, size))) for i, t in enumerate(items) if min(seed, len(t)) == size]
        hashes = np.concatenate([h for _, h in own])
        owner = np.concatenate([np.full(len(h), i) for i, h in own])
        order = np.argsort(hashes, kind="stable")
        by_size[size] = hashes[order], owner[order]
    return items, by_size


def _columns(found: list[tuple], names: list[str]) -> dict[str, pa.Array]:
    values = list(zip(*found)) or [()] * len(names)
    return {n: pa.array(v, pa.float64() if n == "coverage" else pa.int64()) for n, v in zip(names, values)}


def _matcher(block, seed: int, coverage: float):
    items, by_size = _index(block, seed)
    # One bit of each seed's hash tells most runs of clean text apart without a search.
    seen = np.zeros(1 << 22, bool)
    for hashes, _ in by_size.values():
        seen[(hashes >> U64(42)).astype(np.int64)] = True

    def of(batch):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            doc = tokens(text)
            near: set[int] = set()
            for size, (hashes, owner) in by_size.items():
                runs = windows(doc, size)
                runs = runs[seen[(runs >> U64(42)).astype(np.int64)]]
                if not len(runs):
                    continue
                runs = np.unique(runs)
                lo, hi = np.searchsorted(hashes, runs, "left"), np.searchsorted(hashes, runs, "right")
                for a, b in zip(lo[hi > lo], hi[hi > lo]):
                    near.update(owner[a:b].tolist())
            for i in sorted(near):
                got = _measure(items[i], doc, seed, coverage)
                if got:
                    out.append((doc_id, block[i][0], *got))
        return _columns(out, ["doc_id", "item_id", "item_tokens", "covered", "n_tiles", "longest", "coverage"])

    return of


def _seeds(texts: DataFrame, key: str, sizes, bits: np.ndarray | None = None) -> DataFrame:
    """(key, size, n_tokens, seed, times) of every distinct run of the sizes that ``sizes`` gives for a text's length."""

    def make():
        def of(batch):
            keys, rows = [], []
            for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                t = tokens(text)
                for size in sizes(len(t)):
                    runs = windows(t, size)
                    if bits is not None:
                        runs = runs[bits[(runs >> U64(64 - BITS)).astype(np.int64)]]
                    if len(runs):
                        h, times = np.unique(runs, return_counts=True)
                        keys += [k] * len(h)
                        rows.append((np.full(len(h), size), np.full(len(h), len(t)), h.view(np.int64), times))
            flat = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 4
            return {key: pa.array(keys, pa.string())} | {n: pa.array(c, pa.int64()) for n, c in zip(("size", "n_tokens", "seed", "times"), flat)}

        return of

    return per_batch(texts.select(key, "text"), f"{key} string, size long, n_tokens long, seed long, times long", make)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of the first BITS bits of a seed; at most 16 MB reach the driver."""
    cell = F.shiftrightunsigned("seed", 64 - BITS) + 1  # bucket 1 begins at 1
    cells = seeds.select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("bit"))
    bits = np.zeros(1 << BITS, bool)
    for row in cells.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("b")).collect():
        some = np.unpackbits(np.frombuffer(row.b, np.uint8), bitorder="little")
        first = (row.bucket - 1) * len(some)
        bits[first : first + len(some)] = some
    return bits


def _joined(rows: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """contaminated() by a join of seeds: no text of the benchmark reaches the driver.

    A tile covers ``size`` tokens or fewer for each seed in it, so a covered item shares at least k of its p seeds with
    the document, k being coverage * tokens / size. The k - 1 that most documents hold can be left out: one of the
    rest is shared still. These rest are the seeds joined, so passages that everyone quotes bring no pairs together.
    """
    items = settle(items.withColumn("ikey", F.sha2(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256)), "items")
    texts = rows.filter(F.col("text") != "").withColumn("tkey", F.sha2("text", 256))
    once = texts.select("tkey", "text").dropDuplicates(["tkey"])
    wanted = settle(_seeds(items, "ikey", lambda n: [min(seed, n)] if n else []), "item-seeds")
    sizes = [r.size for r in wanted.select("size").distinct().collect()]  # at most ``seed``
    mine = settle(_seeds(once, "tkey", lambda n: [s for s in sizes if s <= n], _bitmap(wanted)).select("tkey", "size", "seed"), "doc-seeds")
    held = mine.groupBy("size", "seed").agg(F.count("*").alias("held"))
    known = wanted.join(held, ["size", "seed"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    rarest = W.partitionBy("ikey").orderBy("held", "seed")
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n_tokens") * F.lit(float(coverage))) / F.col("size")))
    before = F.coalesce(F.sum("times").over(rarest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = known.withColumns({"before": before, "p": F.sum("times").over(W.partitionBy("ikey"))})
    joined = known.filter((F.col("before") <= F.col("p") - least) & (F.col("held") > 0)).select("ikey", "size", "seed", "held")
    # a seed of very many documents is met in as many parts, so that no task takes them all
    parts = F.ceil(F.col("held") / 100_000).cast("int")
    split = joined.select("size", "seed", parts.alias("parts")).distinct().filter("parts > 1")
    salted = joined.select("ikey", "size", "seed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    mine = mine.join(split, ["size", "seed"], "left").withColumn(
        "part", F.pmod(F.xxhash64("tkey"), F.coalesce("parts", F.lit(1))).cast("int"))
    pairs = settle(salted.join(mine, ["size", "seed", "part"]).select("tkey", "ikey").distinct(), "pairs")
    both = pairs.join(once, "tkey").join(items.select("ikey", "item_id", F.col("text").alias("item")), "ikey")

    def make():
        def of(batch):
            out, keys = [], []
            for k, i, text, item in zip(*(batch.column(c).to_pylist() for c in ("tkey", "item_id", "text", "item"))):
                got = _measure(tokens(item), tokens(text), seed, coverage)
                if got:
                    keys.append(k)
                    out.append((i, *got))
            return {"tkey": pa.array(keys, pa.string())} | _columns(out, ["item_id", "item_tokens", "covered", "n_tiles", "longest", "coverage"])

        return of

    found = per_batch(both.select("tkey", "item_id", "text", "item"), f"tkey string, item_id long, {_FOUND}", make, rows=64)
    names = ["doc_id", "item_id", "item_tokens", "covered", "n_tiles", "longest", "coverage"]
    return texts.select("tkey", "doc_id").join(found, "tkey").select(*names)
