"""Quality rules by document and by host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.rows import attach
from riskloom.session import settle

from .common import as_bytes, per_batch, windows, word_hashes, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
HOST_RATE = 0.5  # a host whose shrunk failure rate exceeds this is rejected
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    runs = windows(h, window)
    if not len(runs):
        return 0
    _, at, counts = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    edge = np.zeros(len(h) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            n += line in seen
            seen.add(line)
    return n


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        def of(batch):
            found = []
            for text in batch.column("text").to_pylist():
                text = text or b""
                tokens, raw = words(text), np.frombuffer(text, np.uint8)
                points = np.count_nonzero((raw & 0xC0) != 0x80) - np.count_nonzero(_BLANK[raw])
                found.append((len(tokens), points, np.count_nonzero(_SYMBOL[raw]), duplicate_lines(text), repeated_words(word_hashes(tokens))))
            out = {"doc_id": batch.column("doc_id"), "source": batch.column("source")}
            return out | {n: pa.array([int(f[i]) for f in found], pa.int64()) for i, n in enumerate(names)}

        return of

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), as_bytes("text"))
    got = per_batch(rows, "doc_id long, source string, " + ", ".join(f"{n} long" for n in names), make)
    return got.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_rates(measured: DataFrame) -> DataFrame:
    """source, n, failed and host_rate of each host.

    The beta prior has the failure rate m of all documents as mean and, by the variance v of the
    hosts' own rates, the weight s = m (1 - m) / v - 1 in documents. Where the hosts do not differ (v = 0)
    all have rate m; where v is m (1 - m) or more the prior weighs nothing.
    """
    hosts = measured.filter("source IS NOT NULL").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = settle(hosts, "hosts")
    m, v = hosts.agg(F.sum("failed") / F.sum("n"), F.var_pop(F.col("failed") / F.col("n"))).first()
    if v:
        s = max(m * (1 - m) / v - 1, 0.0)
        rate = (F.col("failed") + m * s) / (F.col("n") + s)
    else:
        rate = F.lit(m).cast("double")
    return hosts.withColumn("host_rate", rate)


def judge(docs: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """The measures of every row of ``docs`` (doc_id, text, source; other columns are ignored), host_rate and kept.

    Null texts have no words. A null source is no host: its documents stand for themselves and
    host_rate is null. Repeated rows count and return one by one.
    """
    measured = settle(measure(docs), "measured")
    hosts = host_rates(measured)
    joined = attach(measured, hosts.select("source", "n", "host_rate"), ["source"], table_rows=hosts.count(), weight="n")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= most))
