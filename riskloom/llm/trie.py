"""Prefix trie of conversations: one row for each distinct sequence of first turns.

Conversations are put in the order of their turns and dealt into shards at splitters, conversations of
a sample. All prefixes of the splitters form the skeleton, a small trie that every task gets. A node that
two shards share is a prefix of the splitter between them, so it is in the skeleton; every other node lies
within one shard, whose sorted rows give it in one pass with a stack. Of skeleton nodes each shard gives a
partial aggregate, and these are reduced to one row a node and rolled up along the skeleton.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rows import local_table
from ..session import settle

SHARD_CONVERSATIONS = 4_096
# Bounds of the skeleton: at most so many shards, of whose splitters so many first turns count.
MOST_SHARDS = 8_192
SPLITTER_TURNS = 32
SAMPLED_PER_SHARD = 16
ENDS_PER_CHUNK = 4_096
ROWS_PER_BATCH = 8_192

RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string")
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_LOWEST = -(1 << 63)


def turn_paths(conversations: DataFrame, family=None) -> DataFrame:
    """(family, conv_id, keys, sizes): for each conversation its turns in order, as digests and UTF-8 bytes of the text.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own.
    Null role or text is empty; rows without conv_id belong to no conversation. Texts do not travel beyond
    the ordering: a turn is 16 bytes of digest from there on. ``family``, a column of conv_id, says which
    conversations shall be together in a partition.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("family", F.col("conv_id") if family is None else family).repartition("family")
    order = W.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turn = F.struct(
        F.row_number().over(order).alias("i"),
        F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("key"),
        F.octet_length("text").alias("size"))
    whole = rows.select("family", "conv_id", turn.alias("t")).groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("family", "conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def with_family_head(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Paths in which the first h turns are those of conversation c - c % every, h = crc32(c) % heads, and the rest c's own."""
    c = F.col("conv_id")
    own = turn_paths(conversations, c - c % every)
    first = W.partitionBy("family")
    lead = lambda name: F.coalesce(
        F.max(F.when(F.col("conv_id") == F.col("family"), F.col(name))).over(first), F.slice(name, 1, 0))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    led = own.withColumns({"h": h, "head_keys": lead("keys"), "head_sizes": lead("sizes")})
    mixed = lambda head, tail: F.concat(
        F.slice(head, F.lit(1), F.col("h")), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail) - F.col("h"), F.lit(0))))
    return led.select("conv_id", mixed("head_keys", "keys").alias("keys"), mixed("head_sizes", "sizes").alias("sizes"))


class Skeleton:
    """Trie of the splitters' prefixes; node 0 is the root."""

    def __init__(self, splitters: Sequence[tuple[list[bytes], int]]):
        self.splitters = list(splitters)
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent = [-1]
        for keys, _ in self.splitters:
            at = 0
            for key in keys:
                below = self.child.get((at, key))
                if below is None:
                    below = self.child[at, key] = len(self.parent)
                    self.parent.append(at)
                at = below

    def table(self, spark: SparkSession) -> DataFrame:
        """(skel, parent, skel_children, above): above are the node and its ancestors."""
        kids, above = [0] * len(self.parent), []
        for at, up in enumerate(self.parent):  # parents come before their children
            above.append([at] if up < 0 else [*above[up], at])
            if up >= 0:
                kids[up] += 1
        rows = [(i, up if up >= 0 else None, kids[i], above[i]) for i, up in enumerate(self.parent)]
        return local_table(spark, rows, "skel long, parent long, skel_children long, above array<long>")


def _splitters(paths: DataFrame, n: int) -> list[tuple[list[bytes], int]]:
    """Conversations of a sample, of bounded size, that cut all of them into shards of about one size."""
    shards = min(math.ceil(n / SHARD_CONVERSATIONS), MOST_SHARDS)
    if shards < 2:
        return []
    per_million = min(1_000_000, math.ceil(1e6 * shards * SAMPLED_PER_SHARD / n))
    sample = paths.filter(F.pmod(F.xxhash64("conv_id", F.lit("splitter")), F.lit(1_000_000)) < per_million).select(
        F.slice("keys", 1, SPLITTER_TURNS).alias("keys"), F.when(F.size("keys") <= SPLITTER_TURNS, F.col("conv_id")).otherwise(F.lit(_LOWEST)).alias("conv"))
    rows = sorted(([bytes(k) for k in r["keys"]], r["conv"]) for r in sample.collect())
    picked = [rows[i * len(rows) // shards] for i in range(1, shards)] if rows else []
    return [s for i, s in enumerate(picked) if i == 0 or s != picked[i - 1]]


_SHARD_ROWS = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("skel", T.LongType()), T.StructField("conv_id", T.LongType()),
    T.StructField("depth", T.LongType()), T.StructField("parent_conv_id", T.LongType()), T.StructField("n_convs", T.LongType()),
    T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()), T.StructField("saved_tokens", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("ends", T.StringType())])


class _Node:
    __slots__ = ("depth", "skel", "size", "least", "n", "kids", "leaves", "saved", "ends", "below")

    def __init__(self, depth: int, skel: int, size: int):
        self.depth, self.skel, self.size = depth, skel, size
        self.least, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list | object | None = None
        self.below: list[tuple] = []


def _shard_nodes(rows: Iterator[tuple[int, int, list[bytes], list[int]]], child: dict[tuple[int, bytes], int]) -> Iterator[tuple]:
    """Rows of the nodes of sorted shards: kind "node", or for skeleton nodes "part", and "ends", ids that end there.

    Holds one node for each turn of the conversation at hand, and of each such node outside the skeleton the
    rows of its children, whose parent's smallest member is not known before.
    """
    stack: list[_Node] = []
    path: list[bytes] = []
    now = None

    def closed() -> Iterator[tuple]:
        x = stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.n += x.n
            up.least = x.least if up.least is None else min(up.least, x.least)
        if x.skel >= 0:
            if x.ends:
                yield _ends(x)
            yield ("part", x.skel, x.least, x.depth, None, x.n, x.kids, x.leaves, x.saved, x.size, None)
            return
        leaves, saved = x.leaves if x.kids else 1, x.saved + (x.n - 1) * x.size
        up.kids += 1
        up.leaves += leaves
        up.saved += saved
        for row in x.below:
            yield (*row[:4], x.least, *row[5:])
        row = ("node", up.skel, x.least, x.depth, None, x.n, x.kids, leaves, saved, x.size, x.ends.hexdigest() if x.ends else _EMPTY_SHA)
        if up.skel >= 0:
            yield row
        else:
            up.below.append(row)

    for shard, conv, keys, sizes in rows:
        common = 0
        if shard != now:
            while stack:
                yield from closed()
            now, path = shard, []
            stack.append(_Node(0, 0, 0))
        else:
            top = min(len(path), len(keys))
            while common < top and path[common] == keys[common]:
                common += 1
        while len(stack) > common + 1:
            yield from closed()
        for d in range(common, len(keys)):
            up = stack[-1].skel
            stack.append(_Node(d + 1, child.get((up, keys[d]), -1) if up >= 0 else -1, sizes[d]))
        path = keys
        end = stack[-1]
        end.n += 1
        end.least = conv if end.least is None else min(end.least, conv)
        if end.skel >= 0:
            end.ends = end.ends or []
            end.ends.append(conv)
            if len(end.ends) >= ENDS_PER_CHUNK:
                yield _ends(end)
        elif end.ends is None:
            end.ends = hashlib.sha256(str(conv).encode())
        else:
            end.ends.update(f",{conv}".encode())
    while stack:
        yield from closed()


def _ends(x: _Node) -> tuple:
    ids, x.ends = x.ends, []
    return ("ends", x.skel, ids[0], x.depth, None, 0, 0, 0, 0, 0, ",".join(map(str, ids)))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kind = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(f.name, kind[f.dataType.simpleString()]) for f in schema.fields])


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, keys, sizes), the root at depth 0 included; see RESULT.

    conv_id is the smallest member, parent_conv_id that of the parent (root: null). n_leaves and saved_tokens cover
    the subtree, its top included: the latter sums (n_convs - 1) x bytes of each node's last text. ends_sha256
    digests the ids of members with exactly depth turns, ascending and joined by commas. Conversations without
    turns end at the root. conv_id must be unique and not null; no conversations give no rows.

    A conversation is one row of digests, 16 bytes a turn. A shard's rows are read in order once. The ids that end
    at one skeleton node are digested by one task in bounded memory, as the digest is of one ordered string.
    """
    spark = paths.sparkSession
    paths = settle(paths.select("conv_id", "keys", "sizes"), "paths")
    n = paths.count()
    if not n:
        return local_table(spark, [], RESULT)
    skeleton = Skeleton(_splitters(paths, n))
    child = spark.sparkContext.broadcast((skeleton.child, skeleton.splitters))
    with_shard = T.StructType([T.StructField("shard", T.LongType()), *paths.schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = child.value[1]
        for b in batches:
            convs, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [bisect.bisect_right(splitters, (k, c)) for c, k in zip(convs, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *b.columns], names=with_shard.names)

    shard_schema = _arrow_schema(_SHARD_ROWS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        yield from _batches(_shard_nodes(rows, child.value[0]), shard_schema)

    shards = len(skeleton.splitters) + 1
    dealt = paths.mapInArrow(deal, with_shard).repartition(shards, "shard").sortWithinPartitions("shard", "keys", "conv_id")
    found = settle(dealt.mapInArrow(finish, _SHARD_ROWS), "trie")
    top = _skeleton_rows(spark, found, skeleton)
    columns = [f.strip().split(" ")[0] for f in RESULT.split(",")]
    nodes = found.filter("kind = 'node'").join(
        F.broadcast(top.select(F.col("skel").alias("up"), F.col("conv_id").alias("up_conv"))), F.col("skel") == F.col("up"), "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv")).withColumnRenamed("ends", "ends_sha256")
    return nodes.select(columns).unionByName(top.select(columns))


def _skeleton_rows(spark: SparkSession, found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Rows of the skeleton's nodes: partial aggregates reduced, then subtree sums along the skeleton."""
    shape = skeleton.table(spark)
    parts = found.filter("kind = 'part'").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("size").alias("size"))
    nodes = parts.join(shape, "skel").withColumn("n_children", F.col("n_children") + F.col("skel_children"))
    nodes = settle(nodes.withColumns({
        "leaves": F.col("leaves") + (F.col("n_children") == 0).cast("long"),
        "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("size")}), "skeleton")
    sums = nodes.select(F.explode("above").alias("skel"), "leaves", "saved").groupBy("skel").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ups = nodes.select(F.col("skel").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.drop("leaves", "saved").join(sums, "skel").join(ups, "parent", "left").join(_digests(found), "skel", "left")
    return settle(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA))), "skeleton")


def _digests(found: DataFrame) -> DataFrame:
    """(skel, ends_sha256): the ids that end at a skeleton node, read in order, chunk after chunk."""
    schema = T.StructType([T.StructField("skel", T.LongType()), T.StructField("ends_sha256", T.StringType())])
    arrow = _arrow_schema(schema)
    chunks = found.filter("kind = 'ends'").select("skel", "conv_id", "ends").repartition("skel").sortWithinPartitions("skel", "conv_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, state = None, None
            for b in batches:
                for skel, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    if skel != at:
                        if state is not None:
                            yield at, state.hexdigest()
                        at, state = skel, hashlib.sha256(ids.encode())
                    else:
                        state.update(b"," + ids.encode())
            if state is not None:
                yield at, state.hexdigest()
        yield from _batches(rows(), arrow)

    return chunks.mapInArrow(digest, schema)
