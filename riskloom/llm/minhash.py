"""Near duplicates by b-bit MinHash.

Documents of one shingle set become one node. Bands of minima put nodes in buckets. Candidate
pairs first pass a comparison of packed low bits of all minima, corrected for chance agreement,
then of the whole shingle sets. Components grow in rounds, so that a bucket of n copies costs
about n comparisons: a pair already known to be connected is never formed.

Nodes compared with the same hub H are known by their differences from it. With d(X) the shingles of H that
X lacks, and s the differences that A and B have in common, |A ∩ B| = |H| - d(A) - d(B) + s. So a link needs
s >= (f(A) + f(B)) / (100 + percent) - |H|, where f(X) = (100 + percent) d(X) + percent |X|: most such pairs
need many differences in common, and those that have them are found by their rarest ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import settle

from .common import U64, as_bytes, lists, per_batch, shingle_set

BANDS, ROWS = 32, 5
BITS = 2  # low bits kept of each minimum
SIGMAS = 5.0  # a pair is dropped unread only if its estimate is so many standard deviations low
FIRST_PIVOTS, PAIRS_PER_NODE = 64, 2_000
_SEED = 20_240_601


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, n, dtype=np.uint64) | U64(1)


def minima(shingles: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Smallest value of each multiplicative hash over the set."""
    best = np.full(len(mult), np.iinfo(np.uint64).max, dtype=U64)
    for i in range(0, len(shingles), 512):
        np.minimum(best, (shingles[i : i + 512, None] * mult[None, :]).min(axis=0), out=best)
    return best


def packed(least: np.ndarray) -> np.ndarray:
    """BITS planes of 64-bit words; bit i of a plane belongs to minimum i."""
    planes = []
    for b in range(BITS):
        bits = ((least >> U64(32 + b)) & U64(1)).astype(np.uint8)
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        planes.append(np.packbits(bits, bitorder="little").view(np.int64))
    return np.concatenate(planes)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = (key ^ least.reshape(bands, rows)[:, i]) * U64(0xD6E8FEB86659FD93)
        key ^= key >> U64(32)
    return key.view(np.int64)


def sketch(docs: DataFrame, shingle_words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, null if empty), planes, bands."""

    def make():
        mult = _multipliers(bands * rows)

        def of(batch: pa.RecordBatch):
            nodes, sizes, planes, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, shingle_words)
                sizes.append(len(s))
                if len(s):
                    least = minima(s, mult)
                    nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    planes.append(packed(least))
                    keys.append(band_keys(least, bands, rows))
                else:
                    nodes.append(None)
                    planes.append(np.empty(0, np.int64))
                    keys.append(np.empty(0, np.int64))
            return {
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.binary()),
                "planes": lists(np.concatenate(planes), [len(x) for x in planes], pa.int64()),
                "bands": lists(np.concatenate(keys), [len(x) for x in keys], pa.int64()),
            }

        return of

    return per_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text")),
        "doc_id long, n_shingles long, node binary, planes array<long>, bands array<long>", make)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, hashes: int = BANDS * ROWS) -> DataFrame:
    """The pairs (a, b) whose set sizes allow a link and whose estimated similarity does not rule it out.

    Two different minima agree in BITS bits by chance with probability c = 2^-BITS, so a share m
    of agreeing minima estimates the similarity as (m - c) / (1 - c).
    """
    t, c = percent / 100, 2.0**-BITS
    m = c + (1 - c) * t
    floor = t - SIGMAS * math.sqrt(m * (1 - m) / hashes) / (1 - c)
    words = -(-hashes // 64)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("planes").alias(f"p{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    differ = None
    for w in range(words):
        bits = None
        for p in range(BITS):
            x = F.col("pa")[p * words + w].bitwiseXOR(F.col("pb")[p * words + w])
            bits = x if bits is None else bits.bitwiseOR(x)
        differ = F.bit_count(bits) if differ is None else differ + F.bit_count(bits)
    estimate = ((hashes - differ) / F.lit(float(hashes)) - c) / (1 - c)
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return both.filter((100 * small >= percent * large) & (estimate >= floor)).select("a", "b")


def texts_of(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """One text (node, text) for each node wanted, whose smallest document is ``rep``."""

    def make():
        def of(batch):
            text = batch.column("text").to_pylist()
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in (shingle_set(t, shingle_words) for t in text)]
            return {"node": pa.array(nodes, pa.binary()), "text": pa.array(text, pa.binary())}

        return of

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text")).join(
        wanted.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return per_batch(rows, "node binary, text binary", make).filter("node is not null").groupBy("node").agg(F.min("text").alias("text"))


def confirm(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """a, b, shared |A ∩ B| of full sets, linked: whether 100 |A ∩ B| >= percent |A ∪ B|, and delta, the shingles that one of both has."""

    def make():
        def of(batch):
            keep, inner, apart, last, sa = [], [], [], None, None
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if x != last:
                    last, sa = x, shingle_set(x, shingle_words)
                sb = shingle_set(y, shingle_words)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                inner.append(both)
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both))
                apart.append(np.setxor1d(sa, sb, assume_unique=True).view(np.int64))
            return {"a": batch.column("a"), "b": batch.column("b"), "shared": pa.array(inner, pa.int64()), "linked": pa.array(keep, pa.bool_()),
                    "delta": lists(np.concatenate(apart), [len(x) for x in apart], pa.int64())}

        return of

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return per_batch(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb"),
                     "a binary, b binary, shared long, linked boolean, delta array<long>", make, rows=64)


def own_shingles(nodes: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """node, own: how many of its shingles no other of ``nodes`` has; nodes without any are left out.

    Tasks count shingles before the shuffle, so that a group of copies sends its common ones once a task.
    """
    def make():
        def of(batch):
            node = batch.column("node")
            sets = [shingle_set(t, shingle_words) for t in batch.column("text").to_pylist()]
            found, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[first]
            owner = pa.array(owner, pa.int64(), mask=n > 1)
            return {"h": pa.array(found.view(np.int64)), "node": node.take(owner), "n": pa.array(n, pa.int64())}

        return of

    counted = per_batch(texts.join(nodes, "node", "left_semi"), "h long, node binary, n long", make)
    return counted.groupBy("h").agg(F.sum("n").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def links_by_differences(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of one hub and different components, from node, hub, size, in_hub, hub_size and delta.

    Any link needs at least k(A) common differences, reckoned with the least f that a partner outside A's
    component can have: one that links with the hub has f <= 100 |H|. Two sets that share k items share one of
    the first |delta| - k + 1 of each, in any order of items; taken by rarity, that prefix holds few common ones, and where two meet early in neither they share too few.
    A difference that one node alone has pairs it with none. Each pair is checked on the whole differences.
    """
    whole = 100 + percent
    known = nodes.filter("hub IS NOT NULL").withColumn("f", whole * (F.col("hub_size") - F.col("in_hub")) + percent * F.col("size"))
    known = known.withColumn("apart", F.col("f") > 100 * F.col("hub_size"))
    least = known.groupBy("hub").agg(F.min("f").alias("least"), F.min(F.when(F.col("apart"), F.col("f"))).alias("least_apart"))
    known = known.join(least.filter("least_apart IS NOT NULL"), "hub").withColumn(
        "k", F.expr(f"greatest(1L, (f + if(apart, least, least_apart) + {whole - 1}) div {whole} - hub_size)"))
    known = known.filter(F.size("delta") >= F.col("k")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = settle(known.select("node", "hub", "hub_size", "f", "k", "comp", "delta"), "known")
    items = known.select("hub", "node", F.explode("delta").alias("x"))
    common = items.groupBy("hub", "x").agg(F.count("*").alias("n")).filter("n > 1")
    mine = W.partitionBy("node")
    ranked = items.join(common, ["hub", "x"]).withColumns({
        "place": F.row_number().over(mine.orderBy("n", "x")), "shared": F.count("*").over(mine)})
    side = known.select("node", "comp", "f", "hub_size", F.size("delta").alias("m"), (F.size("delta") - F.col("k") + 1).alias("prefix"))
    # the differences that no other node has come first in the order; left is how many come from here on
    prefix = ranked.join(side, "node").withColumn("place", F.col("place") + F.col("m") - F.col("shared")).filter("place <= prefix").select(
        "hub", "x", "node", "comp", "f", "hub_size", (F.col("m") - F.col("place") + 1).alias("left"))
    prefix = settle(prefix, "prefix")
    other = prefix.select("hub", "x", *[F.col(c).alias(f"p_{c}") for c in ("node", "comp", "f", "left")])
    # at the first item that two nodes share, what is left of either bounds what they share
    enough = whole * F.least("left", "p_left") >= F.col("f") + F.col("p_f") - whole * F.col("hub_size")
    met = prefix.join(other, ["hub", "x"]).filter((F.col("node") < F.col("p_node")) & (F.col("comp") != F.col("p_comp")) & enough)
    pairs = settle(met.select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct(), "pairs")
    of = lambda x: known.select(F.col("node").alias(x), F.col("f").alias(f"f{x}"), F.col("delta").alias(f"d{x}"), F.col("hub_size").alias(f"h{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    need = F.col("fa") + F.col("fb") - whole * F.col("ha")
    return both.filter(whole * F.size(F.array_intersect("da", "db")) >= need).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable. Labels spread along edges and jump to their label's label."""
    edges = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = settle(
            low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("comp"))
        labels = new.select("node", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that links connect; nodes without a label are their own."""
    at = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    lifted = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()
    moved = components(lifted)
    old = labels.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select(
        "node", F.coalesce("to", "comp").alias("comp"))
    new = moved.join(labels.select("node"), "node", "left_anti")
    return settle(old.unionByName(new), "labels")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-white-space after lower-casing A to Z. Null, empty and blank texts have
    no shingle, link with nothing and keep their own id. component_id is the smallest non-null
    doc_id reachable over links; kept is true where it equals doc_id (false for a null id in a
    group with ids; a null id alone gives a null component and false). Repeated rows each return
    a row with the same values. Bands find a pair at the threshold with probability
    1 - (1 - s^5)^32: 1 - 7e-9 at 0.85, 1 - 3e-6 at 0.8.
    """
    rows = settle(sketch(docs, shingle_words), "sketch")
    nodes = settle(
        rows.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("planes").alias("planes"), F.first("bands").alias("bands")),
        "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    entries = settle(keyed.join(shared, "key"), "entries")
    # The hub of a bucket is its node with the most neighbours in all; of a group of copies, one close to their
    # origin. Each node is first compared with the hub that it meets most often.
    weights = entries.groupBy("node").agg(F.sum("n").alias("w"))
    hubs = entries.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("w", "node")).alias("hub"))
    hooks = entries.join(hubs, "key").filter("node <> hub").groupBy("node", "hub").count().groupBy("node").agg(
        F.max_by("hub", F.struct("count", "hub")).alias("a")).select("a", F.col("node").alias("b"))
    bucketed = entries.select("node").distinct()
    texts = settle(texts_of(docs, nodes.join(bucketed, "node", "left_semi"), shingle_words), "texts")
    hooked = settle(confirm(hooks, texts, shingle_words, percent), "hooked")
    labels = settle(components(hooked.filter("linked")), "labels")

    # Rounds over buckets that still hold several components. First, nodes too full of shingles of their own
    # are left out, and those of one hub are linked by their differences from it. The rest are pairs of different
    # hubs. If the pairs across components are no more than PAIRS_PER_NODE times the nodes they are looked at in one round,
    # otherwise for a growing share of each bucket's nodes against all, until all have been.
    most = PAIRS_PER_NODE * nodes.count()
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    told, low, pivots = None, 0, FIRST_PIVOTS
    while True:
        at = entries.join(labels, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
        sizes = at.groupBy("key", "comp").agg(F.count("*").alias("own"), F.max("n").alias("n")).groupBy("key").agg(
            F.count("*").alias("comps"), F.max("n").alias("n"), F.sum("own").alias("all"), F.sum(F.col("own") * F.col("own")).alias("squares"))
        open_keys = settle(sizes.filter((F.col("comps") > 1) & (F.col("n") > low)), "open")
        cross = open_keys.agg(F.sum((F.col("all") * F.col("all") - F.col("squares")) / 2)).first()[0]
        if cross is None:
            break
        entries = settle(at.join(open_keys.select("key"), "key").drop("comp"), "entries")  # a bucket of one component stays one
        if told is None:
            here = entries.select("node").distinct().join(hooked.select(F.col("b").alias("node"), F.col("a").alias("hub"), "shared", "delta"), "node", "left")
            here = settle(here, "here")
            own = own_shingles(here.select("node").union(here.filter("hub IS NOT NULL").select("hub")).distinct(), texts, shingle_words)
            sized = nodes.select("node", F.col("n_shingles").alias("size"))
            facts = here.join(sized, "node").join(own, "node", "left").filter(
                100 * (F.col("size") - F.coalesce("own", F.lit(0))) >= percent * F.col("size"))
            facts = facts.join(sized.select(F.col("node").alias("hub"), F.col("size").alias("hub_size")), "hub", "left")
            facts = settle(facts.select("node", "hub", "size", "hub_size", F.col("shared").alias("in_hub"), "delta"), "told")
            links = settle(links_by_differences(facts, labels, percent), "links")
            if not links.isEmpty():
                labels = _merged(labels, links)
            told = facts.select("node", "hub").join(nodes.select("node", "bands"), "node")
            entries = settle(entries.join(facts.select("node"), "node", "left_semi"), "entries")
            continue
        if cross <= most:
            pivots = 1 << 62
        at = entries.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(told, "node")
        chosen = at.filter((place >= low / F.col("n")) & (place < pivots / F.col("n"))).select(
            *[F.col(c).alias(f"p_{c}") for c in ("key", "node", "bands", "comp", "hub")])
        # A pair is formed in the first band that it shares, if neither hub nor differences have told of it.
        first = F.element_at(F.filter(F.zip_with("bands", "p_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1)
        new = ~F.coalesce((F.col("hub") == F.col("p_hub")) | (F.col("hub") == F.col("p_node")) | (F.col("node") == F.col("p_hub")), F.lit(False))
        met = at.join(chosen, (F.col("key") == F.col("p_key")) & (F.col("comp") != F.col("p_comp")) & new & (first == F.col("key")))
        pairs = met.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
        links = settle(confirm(likely(pairs, nodes, percent), texts, shingle_words, percent).filter("linked").select("a", "b"), "links")
        if not links.isEmpty():
            labels = _merged(labels, links)
        low, pivots = pivots, pivots * 2

    groups = nodes.select("node", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = groups.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = groups.join(ids, "comp").select("node", "component_id")
    full = rows.select("doc_id", "n_shingles", "node")
    out = full.filter("node is not null").join(found, "node").select("doc_id", "n_shingles", "component_id").unionByName(
        full.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
