"""What the operators of this package share: shared-folder tables and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.batches import byte_slices

WORD_CLASS = r"[^\x20\x09-\x0D]+"
ROW_GROUP = 32 << 20  # bytes: what a task that writes or reads a stored table buffers


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[list[str]] = []


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back, and its path: it cuts the lineage and survives lost executors.

    The shuffle files of the write are dropped when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """stored_at()'s table. Inside scratch() it is deleted at its end, unless keep says that it stays."""
    out, path = stored_at(df, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are stored inside it when it ends: what leaves it must be stored with keep, or collected."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def remainder(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample_below(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """About `rows` of df's `total` rows, picked by a hash of the id, so that reruns agree."""
    if total <= rows:
        return df
    share = int(rows / total * 2**31)
    return df.where(F.pmod(F.xxhash64(column, F.lit("fit")), F.lit(2**31)) < share)


def released() -> None:
    """Gives what a finished task freed back to the system: idle Python workers live on beside the stages after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, rows: Callable[[list[list]], list[list]], schema: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over slices of at most batch_bytes, cut by their rows' bytes. rows gets the input columns as lists and returns output columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, batch_bytes):
                out = rows([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target)], schema=target)
                part = out = None
        batch = None
        released()

    return df.mapInArrow(run, schema)


def arrow_append(df: DataFrame, column: str, values: Callable[[list], list[list]], added: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """df, every column passed on as it is, with the columns of the DDL `added` that values makes of one column's list."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    types = to_arrow_schema(new)
    schema = StructType([*df.schema.fields, *new.fields])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, batch_bytes):
                out = values(part.column(at).to_pylist())
                arrays = [*part.columns, *(pa.array(c, type=f.type) for c, f in zip(out, types))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                part = out = arrays = None
        batch = None
        released()

    return df.mapInArrow(run, schema)
