"""Store statistics as rows (db_id, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import KEY_CHARGE, MEMTABLE_BYTES
from .kvlog import latest_listing, readable
from .lsm import LEVELS, current_entries

_OF_NONE = {"sequence_number": 1, "vlog_file_id": 1}


def db_stats(wal: DataFrame, vlog: DataFrame, manifest: DataFrame, sst: DataFrame, memtable_limit: int = MEMTABLE_BYTES) -> DataFrame:
    """Next sequence number, last value-log segment and its length, the open memtable and those not flushed, and files of each level.

    The open memtable has the keys of the last log. A memtable isn't flushed when it is an earlier log's and no table file, of
    those current, has a sequence number as great as its last.

    Each database that any table names has a row for each metric, with zeros where it has nothing; its first number is 1.
    """
    seq = wal.where(readable()).groupBy("db_id").agg((F.max("seq") + 1).alias("sequence_number"))
    # the keys of a log first, then their sums
    keys = wal.where(readable()).groupBy("db_id", "wal_id", "key").agg(F.max("seq").alias("seq"))
    charge = F.sum(F.octet_length("key") + KEY_CHARGE).alias("bytes")
    logs = keys.groupBy("db_id", "wal_id").agg(F.count(F.lit(1)).alias("n"), charge, F.max("seq").alias("seq"))
    open_log = logs.groupBy("db_id").agg(F.max(F.struct("wal_id", "n", "bytes")).alias("r"))
    open_log = open_log.select("db_id", F.col("r.wal_id").alias("last_log"), F.col("r.n").alias("active_memtable_count"), F.col("r.bytes").alias("active_memtable_bytes"))
    flushed = current_entries(sst, manifest).groupBy("db_id").agg(F.max("seq").alias("top"))
    waiting = (F.col("wal_id") < F.col("last_log")) & (F.col("seq") > F.coalesce("top", F.lit(-1)))
    immutable = logs.join(open_log, "db_id").join(flushed, "db_id", "left").groupBy("db_id").agg(F.count_if(waiting).alias("immutable_memtables"))
    open_log = open_log.drop("last_log").join(immutable, "db_id", "left").withColumn("memtable_limit", F.lit(memtable_limit))
    size = F.octet_length("key") + F.octet_length("value") + 13
    ends = vlog.groupBy("db_id").agg(F.max(F.struct("file_id", (F.col("offset") + size).alias("end"))).alias("r"))
    ends = ends.select("db_id", F.col("r.file_id").alias("vlog_file_id"), F.col("r.end").alias("vlog_offset"))
    files = latest_listing(manifest).where("removed_at IS NULL")
    levels = files.groupBy("db_id").agg(*(F.sum((F.col("level") == i).cast("long")).alias(f"level_{i}_sstables") for i in range(LEVELS)))
    wide = seq.join(open_log, "db_id", "full").join(ends, "db_id", "full").join(levels, "db_id", "full").where("db_id IS NOT NULL")
    metrics = [c for c in wide.columns if c != "db_id"]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(_OF_NONE.get(c, memtable_limit if c == "memtable_limit" else 0))).cast("long").alias("value")) for c in metrics)))
    return wide.select("db_id", rows.alias("r")).select("db_id", "r.metric", "r.value")
