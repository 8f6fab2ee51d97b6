"""The order-dependent folds: segment rotation, memtable packing and the splitting of outputs.

Where a record goes depends on all before it in its shard. The rotation is nevertheless done in parallel and exactly: a block
of records is summed up by where each possible first rotation in it leads to, the blocks' sums pass one after the other through
one task for each shard, and then each block is laid out from the place that it is now known to begin at. The other two are one stream for each
shard: its rows are sorted and pass through one task in Arrow batches, with a state of a few numbers (memtable packing: the
keys of one memtable); a shard is never gathered. Shards are independent stores by hash of the key, as many as the data need.
With one shard the layout is that of a single store.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small, materialize
from .kvlog import PUT

#: Rows of a block of the rotation, about; there are two blocks at least.
BLOCK_ROWS = 500_000
SEGMENT_BYTES, MEMTABLE_BYTES = 256 << 20, 4 << 20
#: Bytes that a memtable is charged for a key besides its length, on its first insertion.
KEY_CHARGE = 88


def shard_of(key: str, shards: int) -> Column:
    return (F.pmod(F.xxhash64(key), F.lit(shards)) if shards > 1 else F.lit(0)).cast("int")


def fold(df: DataFrame, shard: str, order: list[str], new: dict[str, str], start: Callable, step: Callable) -> DataFrame:
    """``df`` with columns ``new`` (name: type), which ``step(state, batch)`` gives for each batch of a shard in order.

    ``start(first batch)`` makes a shard's state. ``step`` gets the batch as a dict of numpy arrays or lists.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {n} {t}" for n, t in new.items())
    rows = df.repartition(shard).sortWithinPartitions(shard, *order)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in it:
            shards = batch.column(names.index(shard)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(shards[1:] != shards[:-1])[0] + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shards[a] != now:
                    now, state = shards[a], start(part)
                out = step(state, part)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[n], pa.int64()) for n in new)], [*names, *new])

    return rows.mapInArrow(batches, schema)


class _Segments:
    """State of the rotation: the open segment and its length."""

    def __init__(self, file_id: int, offset: int, limit: int) -> None:
        self.file_id, self.offset, self.limit = file_id, offset, limit

    def place(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A record that doesn't fit opens a new segment unless the open one is empty; whole runs are placed at once."""
        ends = np.cumsum(sizes)
        files, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        i = 0
        while i < len(sizes):
            base = (ends[i - 1] if i else 0) - self.offset
            fit = int(np.searchsorted(ends, base + self.limit, "right"))
            if fit <= i:
                if self.offset > 0:
                    self.file_id, self.offset = self.file_id + 1, 0
                    continue
                fit = i + 1
            files[i:fit] = self.file_id
            offsets[i:fit] = ends[i:fit] - sizes[i:fit] - base
            self.offset = int(ends[fit - 1] - base)
            i = fit
        return files, offsets


def vlog_layout(mutations: DataFrame, limit: int = SEGMENT_BYTES, shards: int = 1, first: tuple[int, int] = (1, 0), extra: tuple = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(shard, seq, key, value_size, rec_size, file_id, offset) of the puts in the order of ``seq``, appended from ``first`` on.

    ``extra`` columns pass through. A record longer than a segment has one of its own. Null keys and values have no bytes.
    """
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    puts = mutations.where((F.col("vtype") == PUT) & F.col("seq").isNotNull())
    rows = puts.select(shard_of("key", shards).alias("shard"), "seq", "key", size("value").alias("value_size"), (size("key") + size("value") + 13).alias("rec_size"), *extra)
    return _rotate_blocks(rows, limit, first, max(2, -(-rows.count() // block_rows)))


def summarize(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """Where the first rotation in a block leads to: (upto, rotations, offset at the end) for each place it can be at.

    The first rotation is at the first record whose end in the block is beyond what the open segment had left; ``upto`` is
    that end. Neighbouring places that lead to the same are one, as most are: streams that begin apart soon fall in step.
    Only records that end within a segment's length from the block's start, and the one after, can be the first.
    """
    n, ends = len(sizes), np.cumsum(sizes)
    starts = ends - sizes
    follow = np.maximum(np.arange(n) + 1, np.searchsorted(ends, starts + limit, "right")).tolist()
    rotations, offsets, total = [1] * n, [0] * n, int(ends[-1])
    for i in range(n - 1, -1, -1):
        q = follow[i]
        if q < n:
            rotations[i], offsets[i] = rotations[q] + 1, offsets[q]
        else:
            offsets[i] = total - int(starts[i])
    upto, out_rotations, out_offsets = [], [], []
    for i in range(min(n, max(2, int(np.searchsorted(ends, limit, "right")) + 1))):
        if upto and (out_rotations[-1], out_offsets[-1]) == (rotations[i], offsets[i]):
            upto[-1] = int(ends[i])
        else:
            upto.append(int(ends[i]))
            out_rotations.append(rotations[i])
            out_offsets.append(offsets[i])
    return upto, out_rotations, out_offsets


def after_block(file_id: int, offset: int, limit: int, first_size: int, total: int, pieces: tuple[list, list, list]) -> tuple[int, int]:
    """The open segment and its length after a block, given those before it."""
    upto, rotations, offsets = pieces
    left = limit - offset if offset else max(limit, first_size)  # an empty segment takes any record
    at = bisect_right(upto, left)
    if at == len(upto):
        return file_id, offset + total
    return file_id + int(rotations[at]), int(offsets[at])


def _rotate_blocks(rows: DataFrame, limit: int, first: tuple[int, int], blocks: int) -> DataFrame:
    """The rotation by blocks; records have bytes, as their heads alone have thirteen.

    A block's sum is a row for each outcome that its first rotation can have: a few where records differ in size, and at most
    as many as it has records in one segment. The task of a shard sees them one block at a time.
    """
    flat = materialize(rows.repartitionByRange(blocks, "shard", "seq").withColumn("_part", F.spark_partition_id()), "blocks")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("seq")["rec_size"].to_numpy()
        upto, rotations, offsets = summarize(sizes, limit)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "_part": pdf["_part"].iloc[0], "first_size": sizes[0], "total": sizes.sum(), "upto": upto, "rotations": rotations, "offsets": offsets})

    names = ["shard", "_part", "first_size", "total", "upto", "rotations", "offsets"]

    def compose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, pieces = first, None, []

        def after() -> tuple[int, int]:
            own = np.concatenate(pieces, axis=1)
            return after_block(*at, limit, int(own[2][0]), int(own[3][0]), (own[4], own[5], own[6]))

        for batch in it:
            cols = np.array([batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in names], np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1).tolist(), cols.shape[1]]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                now = (int(cols[0][a]), int(cols[1][a])) if b > a else block
                if now != block:
                    at = after() if block and block[0] == now[0] else first
                    block, pieces = now, []
                    out.append((*now, *at))
                pieces.append(cols[:, a:b])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["shard", "_part", "_file", "_offset"])

    sums = flat.select("shard", "_part", "seq", "rec_size").groupBy("shard", "_part").applyInPandas(
        summary, "shard int, _part int, first_size bigint, total bigint, upto bigint, rotations bigint, offsets bigint"
    )
    sums = sums.repartition("shard").sortWithinPartitions("shard", "_part", "upto")
    begins = materialize(sums.mapInArrow(compose, "shard int, _part int, _file bigint, _offset bigint"), "begins")
    # a row for each block and for each shard that begins inside one
    units = flat.join(if_small(begins, begins.count()), ["shard", "_part"]).withColumn("_unit", F.concat_ws("/", "shard", "_part"))
    names_ = units.columns

    def start(part: pa.RecordBatch) -> _Segments:
        return _Segments(part.column(names_.index("_file"))[0].as_py(), part.column(names_.index("_offset"))[0].as_py(), limit)

    def step(state: _Segments, part: pa.RecordBatch) -> dict:
        files, offsets = state.place(part.column(names_.index("rec_size")).to_numpy(zero_copy_only=False))
        return {"file_id": files, "offset": offsets}

    placed = fold(units, "_unit", ["seq"], {"file_id": "bigint", "offset": "bigint"}, start, step)
    return placed.select(*rows.columns, "file_id", "offset")


def append_layout(records: DataFrame, shard: str, order: list[str], size: str, first_file: str, first_offset: str, limit: int) -> DataFrame:
    """``records`` with (new_file_id, new_offset): each shard's records appended to its open segment, given in each row."""
    names = records.columns

    def start(part: pa.RecordBatch) -> _Segments:
        return _Segments(part.column(names.index(first_file))[0].as_py(), part.column(names.index(first_offset))[0].as_py(), limit)

    def step(state: _Segments, part: pa.RecordBatch) -> dict:
        files, offsets = state.place(part.column(names.index(size)).to_numpy(zero_copy_only=False))
        return {"new_file_id": files, "new_offset": offsets}

    return fold(records, shard, order, {"new_file_id": "bigint", "new_offset": "bigint"}, start, step)


class _Memtable:
    def __init__(self) -> None:
        self.run, self.used, self.keys = 1, 0, set()


def memtable_runs(mutations: DataFrame, limit: int = MEMTABLE_BYTES, shards: int = 1) -> DataFrame:
    """(shard, seq, key, vtype, value, run_id): the memtable each mutation goes to, every mutation a batch of its own.

    A memtable is charged once for each of its keys and is closed after the mutation that brings it to ``limit``.
    """
    rows = mutations.where("seq IS NOT NULL AND key IS NOT NULL")
    rows = rows.select(shard_of("key", shards).alias("shard"), "seq", "key", "vtype", "value", (F.octet_length("key") + KEY_CHARGE).cast("long").alias("charge"))

    def step(state: _Memtable, part: pa.RecordBatch) -> dict:
        runs = []
        for key, charge in zip(part.column(2).to_pylist(), part.column(5).to_pylist()):
            if key not in state.keys:
                state.keys.add(key)
                state.used += charge
            runs.append(state.run)
            if state.used >= limit:
                state.run, state.used, state.keys = state.run + 1, 0, set()
        return {"run_id": runs}

    return fold(rows, "shard", ["seq"], {"run_id": "bigint"}, lambda part: _Memtable(), step).drop("charge")


def memtable_usage(runs: DataFrame) -> DataFrame:
    """(shard, run_id, entries, bytes) of each memtable: its keys and what they are charged."""
    keys = runs.select("shard", "run_id", "key").distinct()
    return keys.groupBy("shard", "run_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("key") + KEY_CHARGE).cast("long").alias("bytes"))


class _Output:
    def __init__(self) -> None:
        self.file, self.used = 0, 0


def split_outputs(entries: DataFrame, shard: str, order: list[str], size: str, limit: int = MEMTABLE_BYTES) -> DataFrame:
    """``entries`` with ``out_no``, the number from 0 of the output file: a file is closed by the entry that brings it to ``limit``."""
    at = entries.columns.index(size)

    def step(state: _Output, part: pa.RecordBatch) -> dict:
        sizes = part.column(at).to_numpy(zero_copy_only=False)
        ends, out, i = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0
        while i < len(sizes):
            base = (ends[i - 1] if i else 0) - state.used
            last = int(np.searchsorted(ends, base + limit, "left"))
            stop = min(last + 1, len(sizes))
            out[i:stop] = state.file
            state.used = int(ends[stop - 1] - base)
            if last < len(sizes):
                state.file, state.used = state.file + 1, 0
            i = stop
        return {"out_no": out}

    return fold(entries, shard, order, {"out_no": "bigint"}, lambda part: _Output(), step)
