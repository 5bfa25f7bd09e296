"""PSI per time window over a stream.

The state is one row of bin counters per open window and feature. Counts are additive
and PSI is not, so PSI is derived only where a row leaves the stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import Baseline, binned_rows, counters, score_counts
from ..session import exists, fresh_path, names_in, remove

BATCH = "batch_id"
FOLDED = "folded_upto"
FOLD_EVERY = 50


def windowed_counts(
    stream: DataFrame, baseline: Baseline, ts: str, width: str, slide: str | None = None, late: str = "1 day"
) -> DataFrame:
    """(window_start, feature, counts), for a stream or a table.

    ``ts`` is cast to a timestamp, since a time without zone carries no watermark. Rows
    later than ``late`` behind the newest are dropped.
    """
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    inner = {f: e for f, e in baseline.inner.items() if f in stream.columns}
    if not inner:
        raise ValueError(f"the stream has none of the baseline's features {sorted(baseline.inner)}; it has {stream.columns}")
    width_bins = max(len(e) for e in inner.values()) + 1
    window = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    rows = binned_rows(timed, inner, ["__ts"])
    counts = rows.groupBy(window.alias("w"), "feature").agg(counters(width_bins))
    return counts.select(F.col("w.start").alias("window_start"), "feature", "counts")


def closed_window_psi(stream: DataFrame, baseline: Baseline, ts: str, width: str, **kw) -> DataFrame:
    """Append-mode stream of PSI rows: each window appears once, when the watermark closes it."""
    return score_counts(windowed_counts(stream, baseline, ts, width, **kw), baseline, ["window_start"])


def start_count_log(
    stream: DataFrame, baseline: Baseline, ts: str, width: str, path: str, checkpoint: str, *, slide: str | None = None,
    late: str = "1 day", trigger: dict | None = None,
) -> StreamingQuery:
    """Keep every window up to date, also open ones.

    Each micro-batch writes the rows that changed to its own folder and overwrites it when
    retried, so the log holds each batch exactly once. After every ``FOLD_EVERY`` batches they are folded,
    see ``fold_count_log``.
    """
    counts = windowed_counts(stream, baseline, ts, width, slide, late)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        if (batch_id + 1) % FOLD_EVERY == 0:
            fold_count_log(batch.sparkSession, path, batch_id)

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _numbered(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the log's folders ``kind=number`` that are written whole."""
    found = [int(n.split("=")[1]) for n in names_in(spark, path) if n.startswith(f"{kind}=")]
    return sorted(n for n in found if exists(spark, f"{path}/{kind}={n}/_SUCCESS"))


def _log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest fold and the batches after it, with their batch ids."""
    folds = [n for n in _numbered(spark, path, FOLDED) if upto is None or n <= upto]
    start = folds[-1] if folds else -1
    names = [n for n in names_in(spark, path) if n.startswith(f"{BATCH}=")]
    batches = sorted(int(n.split("=")[1]) for n in names)
    parts = [f"{path}/{BATCH}={n}" for n in batches if n > start and (upto is None or n <= upto)]
    out = spark.read.parquet(f"{path}/{FOLDED}={start}") if folds else None
    if parts:
        late = spark.read.option("basePath", path).parquet(*parts).withColumn(BATCH, F.col(BATCH).cast("long"))
        out = late if out is None else out.unionByName(late)
    return out


def _newest(log: DataFrame) -> DataFrame:
    newest = Window.partitionBy("window_start", "feature").orderBy(F.desc(BATCH))
    return log.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") == 1).drop("__r")


def fold_count_log(spark: SparkSession, path: str, upto: int) -> None:
    """Fold all batches up to number ``upto`` into one table: the newest row of each window and feature.

    The fold is a folder of its own that counts once it is written whole; folding again writes the same rows to the same
    place. Folders of the generation before the last fold are removed, so a reader that has begun
    on the last one can end, and the log's folders stay as many as the batches of two folds.
    """
    before = [n for n in _numbered(spark, path, FOLDED) if n < upto]
    log = _log(spark, path, upto)
    if log is None:
        return
    _newest(log).coalesce(1).write.mode("overwrite").parquet(f"{path}/{FOLDED}={upto}")
    for n in before[:-1]:
        remove(spark, f"{path}/{FOLDED}={n}")
    old = before[-1] if before else -1
    for name in names_in(spark, path):
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= old:
            remove(spark, f"{path}/{name}")


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest counters of each window and feature: one row each of the last fold, and the batches since."""
    log = _log(spark, path)
    if log is None:
        raise ValueError(f"no batch is logged at {path}")
    return _newest(log).drop(BATCH)


def logged_psi(spark: SparkSession, path: str, baseline: Baseline) -> DataFrame:
    return score_counts(latest_counts(spark, path), baseline, ["window_start"])


@dataclass
class StreamPSI:
    """A running count log; ``psi`` scores all windows as they stand."""

    spark: SparkSession
    query: StreamingQuery
    baseline: Baseline
    path: str

    def psi(self) -> DataFrame:
        return logged_psi(self.spark, self.path, self.baseline)


def stream_psi(
    stream: DataFrame, baseline: Baseline, ts: str, width: str, path: str | None = None, checkpoint: str | None = None, **kw
) -> StreamPSI:
    """PSI per window of a stream in one call: starts the count log, below the shared folder if no path is named."""
    path = path or fresh_path(stream.sparkSession, "count-log")
    query = start_count_log(stream, baseline, ts, width, path, checkpoint or f"{path}-checkpoint", **kw)
    return StreamPSI(stream.sparkSession, query, baseline, path)


def file_stream(spark: SparkSession, folder: str, pattern: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A stream over the parquet files of a folder whose names match ``pattern``."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    for k, v in options.items():
        reader = reader.option(k, v)
    out = reader.parquet(folder)
    return out.select(*columns) if columns else out
