"""Tables that cut lineage, kept in the folder the cluster shares.

Every intermediate that is used twice, or that a later step needs to be stable
under task retries, is written as Parquet under ``spark.checkpoint.dir`` and read
back.  A lost executor then costs its running tasks only.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MADE: list[str] = []
_RECORDS: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is configured and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        _MADE.append(_OWN[0])
    return f"file://{_OWN[0]}"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store a path is in; ``file:///x`` and ``/x`` are the local one."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@atexit.register
def _clear() -> None:
    """Removes what is left of this process's scratch, as far as it can be reached without Spark."""
    for path in _MADE:
        with contextlib.suppress(Exception):
            store, inner = file_system(path)
            store.delete_dir(inner)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path (not yet created) in the shared folder."""
    path = f"{shared_root(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    for record in _RECORDS:
        record.append(path)
    return path


def materialize(df: DataFrame, label: str, dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back; lineage ends there.

    ``dictionary`` off saves the try at one for columns of mostly different values.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    settle(spark)
    back = spark.read.schema(schema).parquet(path)
    back.tidemark_path = path
    return back


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of whole texts stay small: at most ``rows`` rows, unless the session asks for fewer.

    Executors hold a batch several times over, in the JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of jobs whose DataFrames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove scratch paths, whatever file system they are on."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` made and nobody reads any more."""
    for t in tables:
        delete(t.sparkSession, t.tidemark_path)


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The scratch paths that are made inside the block, for a caller that knows when they may go."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def whole_ids(df: DataFrame, column: str) -> None:
    """An error at once where an operator's ids are no whole numbers."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a whole number, not {kind}")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
