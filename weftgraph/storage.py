"""The folder that all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the tables of materialize() lie, for discard().
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The lists that collected() is filling.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    A temporary folder stands in only where the setting is missing and Spark runs in one process, as in local tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage", *, group_rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, and safe from lost executors.

    The shuffle files of this and later jobs of the session go as soon as each job has ended, so that a
    chain of stages never holds more than one stage's. Rows of megabytes need `group_rows`: Parquet looks at its buffers
    every 100 rows only, and a task holds a row group's pages, when it writes and when it reads them.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = new_path(spark, label)
    (df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    for paths in _OPEN:
        paths.append(path)
    return out


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes meanwhile, for remove()."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in written:
        path = _WRITTEN.pop(df, None)
        if path:
            remove(df.sparkSession, path)


#: Bytes of a table that may be sent to every executor; beyond them it is joined by a shuffle.
SMALL_BYTES = 24 << 20


def small_enough(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, marked for broadcast only if its counted rows of about `row_bytes` stay within SMALL_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize() wrote, through the file system that holds it."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
