"""What the training-data operators share: intermediate tables, files in the shared folder, record batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import fresh_path, open_fs, shared_dir, written

__all__ = ["batches", "fresh_path", "open_fs", "out_batch", "parallelism", "schema_of", "shared_dir", "table", "valid_text", "write_file", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_text(name: str = "text") -> Column:
    """A column of texts; bytes that are no UTF-8 become replacement characters before they leave the JVM."""
    return F.make_valid_utf8(F.col(name).cast("string")).alias(name)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle, as the session sizes them for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_file(folder: str, name: str, data: Iterable[bytes]) -> str:
    """Write one whole file under a name of this attempt's own, and move it into place."""
    files, root = open_fs(folder)
    files.create_dir(root, recursive=True)
    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(temp) as out:
        for part in data:
            out.write(part)
    files.move(temp, f"{root}/{name}")
    return f"{folder}/{name}"


def batches(rows: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes at most (one row at least)."""
    for batch in rows:
        parts = max(1, -(-batch.nbytes // limit))
        step = max(1, batch.num_rows // parts)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def out_batch(ddl: str, columns: list) -> pa.RecordBatch:
    """Columns in the order of the DDL string as one record batch."""
    schema = schema_of(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
