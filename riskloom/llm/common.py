"""What the text operators share: words, hashes of words, shingles and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)
_FOLD = U64(0xD6E8FEB86659FD93)
# Rows of text that Python holds at a time; a batch never has more.
TEXT_ROWS = 512


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 09 to 0D hex."""
    return text.split() if text else []


def word_hashes(tokens: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=U64, count=len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * _MIX
    return h ^ (h >> U64(29))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _FOLD
        out += h[i : i + n]
    return mixed(out)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; of nothing if empty."""
    tokens = words(text.lower()) if text else []
    if not tokens:
        return np.empty(0, U64)
    return np.unique(windows(word_hashes(tokens), min(k, len(tokens))))


def per_batch(
    df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]], rows: int = TEXT_ROWS,
) -> DataFrame:
    """Map Arrow batches of at most ``rows`` rows. ``make`` runs once a task and gives the function of a batch."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for big in batches:
            for i in range(0, big.num_rows, rows):
                got = of(big.slice(i, rows))
                yield pa.RecordBatch.from_arrays([_arrow(got[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _arrow(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


def lists(flat: np.ndarray, sizes: Sequence[int], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def as_bytes(name: str):
    """A text column as UTF-8 bytes, so that Python need not decode it."""
    return F.col(name).cast("binary").alias(name)


class Memo(dict):
    """Values by key, computed at first use; forgets all once it holds ``limit`` keys. Results never depend on it."""

    def __init__(self, of: Callable, limit: int = 200_000):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.of(key)
        return value
