"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MIN_ROWS = 100
MIN_COLUMNS = 2


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = False, **options) -> DataFrame:
    """CSV with a header. A schema avoids the extra pass that inference needs."""
    reader = spark.read.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has slots.

    A table of many files, as any large one is, comes back as it is. Hashing a key needs
    no sort, unlike a round-robin that has to come out the same when retried.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots, key) if scan.rdd.getNumPartitions() < slots else scan


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def validate_source(df: DataFrame, min_rows: int = MIN_ROWS, min_columns: int = MIN_COLUMNS) -> DataFrame:
    """Raise unless the table has enough rows and columns; reads no more rows than it must."""
    if len(df.columns) < min_columns:
        raise ValueError(f"at least {min_columns} columns needed, got {len(df.columns)}")
    rows = df.limit(min_rows).count()
    if rows < min_rows:
        raise ValueError(f"at least {min_rows} rows needed, got {rows}")
    return df
