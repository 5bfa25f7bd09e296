"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than capacity / (the
next k) and at most capacity / k, and every bin of class k takes exactly k of them. A bin thus
depends on nothing but the piece's number within its class, which the workers work out
independently from a table of counts.

Documents may be cut, so ``cut_lengths`` cuts them at class lengths themselves. With the powers
of two as reciprocals every full bin is full to the last token, and what is left of a class
at the end is dealt into bins of a power of two of pieces, which need no padding either.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import settle

from .common import per_batch

CAPACITY = 2048
END = 1
# Fixed value: how byte-level BPE cuts a text before it merges.
SPLITTER = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BUCKETS = 1024  # groups in which pieces are numbered; the counts table has BUCKETS x classes rows


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def token_ids(path: str):
    """Function from a text to its ids as little-endian unsigned 32-bit bytes; built once a worker.

    The file is a byte-level BPE vocabulary of the tokenizers library. Its ranks are run by tiktoken, which
    gives the same ids in half the time. Special tokens written out in a text are encoded as such,
    as ``encode(text, add_special_tokens=False)`` does.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    to_byte = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in tok.get_vocab(with_added_tokens=False).items()}
    run = tiktoken.Encoding("byte_bpe", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def encode(text: str) -> bytes:
        if marks is None or not marks.search(text):
            ids = run(text)
        else:
            ids, at = [], 0
            for m in marks.finditer(text):
                ids += [*run(text[at : m.start()]), special[m[0]]]
                at = m.end()
            ids += run(text[at:])
        return np.array(ids, "<u4").tobytes()

    return encode


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths, longest first, that a document of n tokens is cut into: full bins, then powers of two."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (array<long>, if kept) and ids_crc32 of every piece of every document."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or byte_bpe_path()

    def make():
        encode = token_ids(path)
        tail = np.asarray([end], "<u4").tobytes()

        def of(batch):
            ids, starts, lengths, crcs, totals, tokens = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = encode(text or "") + tail
                at = 0
                for n in cut_lengths(len(raw) // 4, capacity):
                    part = raw[4 * at : 4 * (at + n)]
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(n)
                    crcs.append(zlib.crc32(part))
                    totals.append(len(raw) // 4)
                    if keep_ids:
                        tokens.append(np.frombuffer(part, "<u4").astype(np.int64))
                    at += n
            out = {name: pa.array(v, pa.int64()) for name, v in (
                ("doc_id", ids), ("start", starts), ("length", lengths), ("ids_crc32", crcs), ("doc_tokens", totals))}
            return out | ({"ids": pa.array(tokens, pa.list_(pa.int64()))} if keep_ids else {})

        return of

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), schema, make)


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Add k (class), sequence_id and offset to pieces whose lengths are capacity / k for a power of two k.

    Pieces are numbered 0, 1, ... within their class: by bucket (a hash of the row), then within it.
    Bin i takes the numbers i k to i k + k - 1. Of the last m < k pieces of a class, runs of a power of
    two, largest first, share a bin. sequence_id has no gap; offsets start at 0 and have none.
    """
    name = [c for c in pieces.columns if c != "ids"]
    dealt = pieces.withColumn("k", (F.lit(capacity) / F.col("length")).cast("long")).withColumn(
        "bucket", F.pmod(F.xxhash64(*name), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("k", "bucket").count()  # at most buckets x log2(2 capacity) rows
    order = W.partitionBy("k").orderBy("bucket")
    before = counts.withColumn("before", F.sum("count").over(order.rowsBetween(W.unboundedPreceding, -1)))
    totals = counts.groupBy("k").agg(F.sum("count").alias("total"))
    # Bins of a class: the full ones and one for each one bit of the remainder.
    bins = (F.floor(F.col("total") / F.col("k")) + F.bit_count(F.expr("total % k"))).cast("long")
    bases = totals.withColumn("base", F.coalesce(
        F.sum(bins).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    lookup = before.join(F.broadcast(bases), "k").select("k", "bucket", F.coalesce("before", F.lit(0)).alias("before"), "total", "base")
    number = F.row_number().over(W.partitionBy("k", "bucket").orderBy(*[c for c in name])) - 1
    rows = dealt.withColumn("number", number).join(F.broadcast(lookup), ["k", "bucket"]).withColumn("number", F.col("number") + F.col("before"))
    rows = rows.withColumn("full", F.expr("total div k")).withColumn("slot", F.expr("number div k"))
    # In the remainder the place p belongs to the run of the highest bit in which p and the remainder differ.
    rows = rows.withColumn("rest", F.expr("total % k")).withColumn("p", F.expr("number % k"))
    rows = rows.withColumn("bits", F.length(F.bin(F.expr("rest ^ p")))).withColumn("above", F.expr("shiftright(rest, CAST(bits AS INT))"))
    tail = F.col("slot") >= F.col("full")
    return rows.select(
        *pieces.columns, "k",
        (F.col("base") + F.col("slot") + F.when(tail, F.bit_count("above")).otherwise(0)).cast("long").alias("sequence_id"),
        (F.when(tail, F.col("p") - F.expr("shiftleft(above, CAST(bits AS INT))")).otherwise(F.col("p")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document (doc_id, text; other columns are ignored) with its sequence and offset.

    A null or empty text is the end token alone. Repeated rows are packed each. A null doc_id stays null.
    Texts are encoded whole. The pieces are written once, so that numbers never change under a retry.
    """
    return harmonic_pack(settle(tokenized_pieces(docs, tokenizer, capacity, end, keep_ids), "pieces"), capacity)
