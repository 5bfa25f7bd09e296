"""Streams give what the batch operators give; late rows follow the watermark."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators.drift import fit_baseline, psi_by_window
from riskloom.session import names_in
from riskloom.streaming import drift
from riskloom.streaming.drift import closed_window_psi, file_stream, fold_count_log, latest_counts, logged_psi, start_count_log, stream_psi


def _write(spark, path, name, rows):
    spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.parquet(f"{path}/{name}")


def _at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_update_mode_keeps_open_windows(spark, tmp_path):
    base = fit_baseline(spark.range(100).select(F.col("id").cast("double").alias("value")))
    src = f"{tmp_path}/in"
    first = [(_at(d, h), float((d * 7 + h * 3) % 100)) for d in (1, 2) for h in range(24)]
    second = [(_at(d, h), float((d * 11 + h * 5) % 100)) for d in (2, 3) for h in range(24)]
    log, mark = f"{tmp_path}/log", f"{tmp_path}/mark"
    for name, rows in (("a", first), ("b", second)):  # day 2 arrives in two runs
        _write(spark, src, name, rows)
        stream = spark.readStream.schema("ts timestamp, value double").option("recursiveFileLookup", True).parquet(src)
        start_count_log(stream, base, "ts", "1 day", log, mark).awaitTermination()
    everything = spark.createDataFrame(first + second, "ts timestamp, value double")
    want = {(r["window_start"], r["feature"]): (r["psi"], r["n_rows"]) for r in psi_by_window(everything, base, "ts", "1 day").collect()}
    got = {(r["window_start"], r["feature"]): (r["psi"], r["n_rows"]) for r in logged_psi(spark, log, base).collect()}
    assert got == want and len(got) == 3


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    base = fit_baseline(spark.range(100).select(F.col("id").cast("double").alias("value")))
    src, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    runs = [
        [(_at(1, h), float(h)) for h in range(24)],
        [(_at(5, h), float(h)) for h in range(24)],
        [(_at(1, 5), 99.0), (_at(9), 1.0)],  # the first is four days late
        [(_at(12), 1.0)],
    ]
    for i, rows in enumerate(runs):
        _write(spark, src, f"r{i}", rows)
        stream = spark.readStream.schema("ts timestamp, value double").option("recursiveFileLookup", True).parquet(src)
        q = closed_window_psi(stream, base, "ts", "1 day", late="1 day").writeStream.outputMode("append").format("parquet")
        q.option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = {r["window_start"].day: r["n_rows"] for r in spark.read.parquet(out).collect()}
    assert rows[1] == 24 and rows[5] == 24 and rows[9] == 1 and 12 not in rows


def test_file_stream_over_events(spark, folder):
    stream = file_stream(spark, folder, "events.parquet", ["ts", "value"])
    assert stream.isStreaming and stream.columns == ["ts", "value"]


def test_one_call_gives_psi_of_open_windows(spark, tmp_path):
    base = fit_baseline(spark.range(100).select(F.col("id").cast("double").alias("value")))
    rows = [(_at(d, h), float((d * 7 + h * 3) % 100)) for d in (1, 2) for h in range(24)]
    _write(spark, f"{tmp_path}/in", "a", rows)
    stream = spark.readStream.schema("ts timestamp, value double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = stream_psi(stream, base, "ts", "1 day")
    run.query.awaitTermination()
    want = psi_by_window(spark.createDataFrame(rows, "ts timestamp, value double"), base, "ts", "1 day").select("window_start", "psi", "n_rows")
    assert sorted(run.psi().select("window_start", "psi", "n_rows").collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="none of the baseline's features"):
        stream_psi(stream.withColumnRenamed("value", "other"), base, "ts", "1 day")


def _log_rows(batch):
    """A batch of three windows, the oldest of them sealed by later batches."""
    return [(_at(1) + datetime.timedelta(days=batch // 10 + d), "value", [batch, d]) for d in range(3)]


def test_reading_costs_windows_and_not_batches(spark, tmp_path):
    """A thousand batches: folding keeps few folders, a second fold and a retried batch change nothing, rows are the newest."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path, want = tmp_path / "log", {}
    schema = pa.schema([("window_start", pa.timestamp("us", tz="UTC")), ("feature", pa.string()), ("counts", pa.list_(pa.int64()))])

    def put(b):
        at = path / f"batch_id={b}"
        at.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_log_rows(b)), schema)], schema=schema), at / "part-0.parquet")
        (at / "_SUCCESS").touch()
        want.update({(w, f): c for w, f, c in _log_rows(b)})

    for b in range(1_000):
        put(b)
        if b % drift.FOLD_EVERY == drift.FOLD_EVERY - 1 and b < 960:
            fold_count_log(spark, str(path), b)
    of = lambda: {(r["window_start"], r["feature"]): r["counts"] for r in latest_counts(spark, str(path)).collect()}
    assert of() == want and len(names_in(spark, str(path))) <= 2 * drift.FOLD_EVERY + 2
    fold_count_log(spark, str(path), 949)
    put(999)
    assert of() == want and len(want) == 102


def test_a_fold_that_was_cut_short_does_not_count(spark, tmp_path):
    base = spark.createDataFrame(_log_rows(0), "window_start timestamp, feature string, counts array<bigint>")
    base.write.parquet(f"{tmp_path}/batch_id=0")
    base.limit(1).withColumn("batch_id", F.lit(0).cast("long")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(f"{tmp_path}/folded_upto=0")
    assert latest_counts(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError, match="no batch"):
        latest_counts(spark, f"{tmp_path}/none")
