"""The folder that driver and executors share: side files, and tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one use of ``name``, below ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset and the master is
    local is a temporary folder made and set for the context: executors of a cluster
    would each see a folder of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()  # a path without a scheme is the default store's
    return f"{whole.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_intermediate: list[str] = []


def written(df: DataFrame, name: str, fewer: int = 1) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage there.

    ``fewer`` joins that many shuffle partitions into one task and file: for narrow
    rows, of which a partition would make a file of a few kilobytes.
    """
    if fewer > 1:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // fewer))
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    _intermediate.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediate(spark: SparkSession) -> int:
    """Delete the tables that ``written`` has made for this driver so far, and count them.

    Results that were not saved, and manifests that were not read, are lost with them.
    """
    paths = list(_intermediate)
    _intermediate.clear()
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(paths)


def filesystem(uri: str):
    """pyarrow's file system for ``uri``, and the path within it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write: Callable) -> None:
    """Let ``write(stream)`` fill a file that appears under ``uri`` only when it is whole."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    partial = f"{path}.partial-{uuid.uuid4().hex}"
    with files.open_output_stream(partial) as out:
        write(out)
    files.move(partial, path)
