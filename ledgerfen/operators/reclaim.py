"""Reclaiming value-log segments: liveness, garbage ratios, the candidate, its rewriting and the state afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import if_small
from .folds import append_layout
from .kvlog import POINTER
from .logs import checked_values
from .ordered import running

THRESHOLD = 0.5
PLACE = ["db_id", "file_id", "offset"]


def records(vlog: DataFrame, segments: DataFrame) -> DataFrame:
    """(db_id, file_id, offset, rec_size, key) of the records of segments that aren't dropped, one for each place.

    Of different records at a place the one with the greatest key, then the longest value counts. The size is computed, as
    stated ones may be wrong. No value goes further than the scan: its length is all that is shuffled.
    """
    dropped = segments.where("dropped_at IS NOT NULL").select("db_id", "file_id").distinct()
    rows = vlog.where("db_id IS NOT NULL AND file_id IS NOT NULL AND offset IS NOT NULL").select(*PLACE, "key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("size"))
    rows = rows.join(if_small(dropped, segments.count()), ["db_id", "file_id"], "left_anti")
    one = rows.groupBy(*PLACE).agg(F.max(F.struct("key", "size")).alias("r")).select(*PLACE, "r.key", "r.size")
    return one.select(*PLACE, "key", (F.coalesce(F.octet_length("key"), F.lit(0)) + F.col("size") + 13).cast("long").alias("rec_size"))


def liveness(records: DataFrame, state: DataFrame) -> DataFrame:
    """``records`` with ``live``: whether the current entry of the record's key points at it."""
    now = state.where("offset IS NOT NULL").select(*PLACE, "key", F.lit(True).alias("live"))
    return records.join(now, [*PLACE, "key"], "left").withColumn("live", F.coalesce("live", F.lit(False)))


def segment_ratio(marked: DataFrame) -> DataFrame:
    """(db_id, file_id, total_bytes, live_bytes, ratio): the share of garbage of each segment."""
    live = F.sum(F.when(F.col("live"), F.col("rec_size")).otherwise(0))
    sums = marked.groupBy("db_id", "file_id").agg(F.sum("rec_size").alias("total_bytes"), live.alias("live_bytes"))
    return sums.withColumn("ratio", 1 - F.col("live_bytes") / F.col("total_bytes"))


def candidates(ratios: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(db_id, file_id, ratio, due) of the oldest segment of each database that isn't the last; only this one is looked at."""
    edge = ratios.groupBy("db_id").agg(F.min("file_id").alias("oldest"), F.max("file_id").alias("active")).where("oldest < active")
    first = ratios.join(edge.select("db_id", F.col("oldest").alias("file_id")), ["db_id", "file_id"])
    return first.select("db_id", "file_id", "ratio", (F.col("ratio") >= threshold).alias("due"))


def damaged(vlog: DataFrame, due: DataFrame) -> DataFrame:
    """(db_id, file_id, bad) of the due segments that have records whose stated checksum is wrong, with their number.

    Only the records of due segments, one a database at most, are read through.
    """
    own = due.where("due").select("db_id", "file_id")
    rows = checked_values(vlog.join(if_small(own, own.count()), ["db_id", "file_id"], "left_semi")).distinct()
    return rows.where("NOT ok").groupBy("db_id", "file_id").agg(F.count(F.lit(1)).alias("bad"))


def safe(due: DataFrame, broken: DataFrame) -> DataFrame:
    """``due`` without the damaged segments: what comes after a damaged record may be live, so the segment stays as it is."""
    return due.join(broken.select("db_id", "file_id"), ["db_id", "file_id"], "left_anti")


def rewrite(marked: DataFrame, due: DataFrame, limit: int) -> DataFrame:
    """(db_id, key, seq_step, old and new place, rec_size) of the live records of the due segments, appended in the order of their offsets.

    They go to the end of the database's last segment; ``seq_step`` is what to add to its last sequence number.
    """
    ends = marked.groupBy("db_id").agg(F.max(F.struct("file_id", (F.col("offset") + F.col("rec_size")).alias("end"))).alias("e"))
    moved = marked.where("live").join(due.where("due").select("db_id", "file_id"), ["db_id", "file_id"], "left_semi")
    rows = moved.join(ends, "db_id").select(*PLACE, "key", "rec_size", F.col("e.file_id").alias("open_file"), F.col("e.end").alias("open_offset"))
    placed = append_layout(rows, "db_id", ["file_id", "offset"], "rec_size", "open_file", "open_offset", limit)
    steps = running(placed.withColumn("_one", F.lit(1)), ["db_id"], ["file_id", "offset"], {"seq_step": ("count", "_one")}, inclusive=True)
    return steps.select(*PLACE, "key", "rec_size", F.col("seq_step").cast("long").alias("seq_step"), "new_file_id", "new_offset")


def state_after(state: DataFrame, moved: DataFrame) -> DataFrame:
    """``state`` with the new places of the records that moved; a key that points elsewhere by now keeps its pointer.

    The join on key and old place is the check before re-pointing.
    """
    to = moved.select(*PLACE, "key", "new_file_id", "new_offset")
    both = state.join(to, [*PLACE, "key"], "left")
    return both.select("db_id", "key", F.coalesce("new_file_id", "file_id").alias("file_id"), F.coalesce("new_offset", "offset").alias("offset"), POINTER[2])
