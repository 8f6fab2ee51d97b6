"""Batches of texts for the Python operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that an operator works on at once, but for single longer texts.
SLICE_BYTES = 4 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many tasks as there are cores; rows are moved only when the scan has fewer splits than that.

    Large tables have more splits than cores and stay as they are. Null keys are fine.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def slices(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``SLICE_BYTES`` of text, or one row; so what is made of them in Python stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
