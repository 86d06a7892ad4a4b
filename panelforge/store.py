"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on this machine alone, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set as checkpoint folder of the context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or FALLBACK_DIR).rstrip("/")


#: Paths given out that are still there.
_given: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes with release(), or when the driver ends."""
    path = f"{shared_dir(spark)}/panelforge-{label}-{uuid.uuid4().hex}"
    if not _given:
        atexit.register(_at_end, spark)
    _given.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove all that has been written to fresh paths so far, and say how many there were.

    For sessions that run one query after the other: results that were handed out and aren't read or saved yet rest on such tables."""
    n = len(_given)
    while _given:
        at = spark._jvm.org.apache.hadoop.fs.Path(_given.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def _at_end(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage is cut, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(path: str):
    """The pyarrow file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_text(path: str) -> str:
    """A whole small file: a list of formulas, settings, a pool."""
    files, at = open_fs(path)
    with files.open_input_file(at) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    """A small file as a whole; its folder is made if it isn't there."""
    files, at = open_fs(path)
    files.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    with files.open_output_stream(at) as f:
        f.write(text.encode())
