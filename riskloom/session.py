"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a fresh temporary folder is used.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there; of several callers, one is told that it did.

    Shared file systems create without overwriting in one step; for a mounted folder the system's own exclusive
    creation does, as Hadoop's local file system looks first and creates then.
    """
    at, fs = _file(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file, whose size the data's rows do not set, without a job."""
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    at, fs = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file(spark, path)
    fs.delete(at, True)


_OWNERS: list[str] = []


@contextmanager
def run_folder(spark: SparkSession):
    """Tables settled within go to one folder below the shared one, which is removed at the end.

    Write what is to stay inside the block: a result that still reads settled tables ends with them. The
    innermost open folder takes what any thread settles.
    """
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _OWNERS.append(path)
    try:
        yield path
    finally:
        _OWNERS.remove(path)
        remove(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_OWNERS[-1] if _OWNERS else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df, name: str = "state", by: tuple[str, ...] = ()):
    """Cut lineage through a written table, which survives the loss of executors. ``by`` are columns that readers filter on."""
    path = fresh_path(df.sparkSession, name)
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
