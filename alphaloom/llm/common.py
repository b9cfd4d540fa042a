"""What the operators of this package share: tables, shared files, row helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")
#: Bytes of rows that a task holds as Python objects at a time.
SLICE_BYTES = 2 << 20
_own_shared_dir: str | None = None
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a new one where that is unset (tests)."""
    global _own_shared_dir
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_shared_dir is None:
        _own_shared_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_shared_dir


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends here, and the table
    outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/alphaloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df.written_path)


def discard_all(spark: SparkSession) -> None:
    """Removes every table that this process has written: for when all results have been stored or shown."""
    for path in list(_written):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _written:
        _written.remove(path)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in batches of about SLICE_BYTES: a batch has ten thousand rows, however long they are."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch, of few megabytes unless a row has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)
