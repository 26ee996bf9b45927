"""Arrow batches in slices of even bytes, and tables with few partitions dealt over all cores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROW = 16  # bytes that a row counts besides its strings


def byte_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes by the running sum of its rows' bytes; a row that alone is longer is
    a slice of its own."""
    n = batch.num_rows
    sizes = np.full(n, float(ROW))
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            sizes += column.nbytes / max(1, n)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0.0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores if its files make fewer scan tasks with rows than there are cores.

    A Parquet file of one row group is one task's work, whatever the split size. Only tables of so few files are dealt
    anew (their rows move once); larger ones, streams and what was dealt before stay as they are.
    """
    if df.isStreaming or "Repartition" in df._jdf.queryExecution().logical().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if files and 4 * len(files) <= cores else df
