"""Write-ahead logs and value logs: valid prefixes, replay, checksums, dereferencing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import crc32c_of, record_hex, value_record_bytes
from ..session import if_small
from .kvlog import DELETE, POINTER, PUT, readable
from .state import latest, live

FILE = ["db_id", "wal_id"]


def valid_prefix(wal: DataFrame) -> DataFrame:
    """The records, each once, that stand before the first torn one of their file; a file with no torn record is whole.

    The first torn record of each file is one aggregated number; it is joined back, so no file is sorted in one task.
    Records without a place (db_id, wal_id, rec_no) are in no file.
    """
    fields = [*FILE, "rec_no", "vtype", "seq", "key", *POINTER]
    rows = wal.where("db_id IS NOT NULL AND wal_id IS NOT NULL AND rec_no IS NOT NULL")
    torn = rows.where(~readable()).groupBy(*FILE).agg(F.min("rec_no").alias("first_torn"))
    torn = if_small(torn, rows.where(~readable()).count())
    kept = rows.join(torn, FILE, "left").where("first_torn IS NULL OR rec_no < first_torn")
    return kept.select(*fields).distinct()


def replay(records: DataFrame) -> DataFrame:
    """(db_id, key, seq, wal_id, rec_no, pointer) of the live keys after inserting the records in log order.

    The order of the log decides, not the sequence number, as the insertion into a memtable does.
    """
    fields = ["rec_no", "seq", "vtype", *POINTER]
    return live(latest(records, ["db_id", "key"], fields, "wal_id")).select("db_id", "key", "seq", "wal_id", "rec_no", *POINTER)


def next_numbers(wal: DataFrame, records: DataFrame) -> DataFrame:
    """(db_id, next_seq, next_wal_id): one above what the replayed records and the files have; 1 without records."""
    files = wal.where("db_id IS NOT NULL").groupBy("db_id").agg((F.coalesce(F.max("wal_id"), F.lit(0)) + 1).alias("next_wal_id"))
    seqs = records.groupBy("db_id").agg(F.max("seq").alias("top"))
    return files.join(seqs, "db_id", "left").select("db_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_seq"), "next_wal_id")


def checked(wal: DataFrame) -> DataFrame:
    """(db_id, wal_id, rec_no, crc, computed, ok) of the readable records: the stated checksum beside the computed one."""
    rows = wal.where(readable()).select(*FILE, "rec_no", "crc", F.unhex(record_hex(F.col("len"), F.col("vtype"), F.col("seq"), F.col("key"), [F.col(c) for c in POINTER])).alias("body"))
    rows = rows.select(*FILE, "rec_no", "crc", crc32c_of("body").alias("computed"))
    return rows.withColumn("ok", F.coalesce(F.col("crc") == F.col("computed"), F.lit(False)))


def checked_values(vlog: DataFrame) -> DataFrame:
    """(db_id, file_id, offset, crc, computed, ok) of the value-log records that have a place, kind, key and value.

    ``ok`` is null where no checksum is stated: such a record is neither right nor damaged.
    """
    rows = vlog.where("db_id IS NOT NULL AND file_id IS NOT NULL AND offset IS NOT NULL AND vtype IS NOT NULL AND key IS NOT NULL AND value IS NOT NULL")
    body = value_record_bytes(F.col("vtype"), F.col("key"), F.col("value"))
    return rows.select("db_id", "file_id", "offset", "crc", crc32c_of(body).alias("computed")).withColumn("ok", F.col("crc") == F.col("computed"))


def deref(pointers: DataFrame, vlog: DataFrame) -> DataFrame:
    """(db_id, key, status, value) of pointers: a record must stand there, its value have the stated size and its checksum be right.

    Records repeated in the value log count once; of different ones at a place the greatest (arrival, value) counts. A record
    without a stated checksum can't be wrong in it. Records that no pointer leads to are left out before anything is shuffled
    when the pointers are few; checksums are worked out for records that are returned only.
    """
    place = ["db_id", "file_id", "offset"]
    pointers = pointers.select("db_id", "key", *POINTER)
    wanted = if_small(pointers.select(*place), pointers.count())
    fields = ["arrived_at", "value", "crc", "vtype", F.col("key").alias("own_key")]
    last = vlog.where("offset IS NOT NULL").join(wanted, place, "left_semi").groupBy(*place).agg(F.max(F.struct(*fields)).alias("r"))
    rows = pointers.join(last.select(*place, "r.*", F.lit(True).alias("there")), place, "left")
    fits = F.octet_length("value") == F.col("value_size")
    stated = fits & F.col("crc").isNotNull() & F.col("vtype").isNotNull() & F.col("own_key").isNotNull()
    rows = rows.withColumn("computed", crc32c_of(F.when(stated, value_record_bytes(F.col("vtype"), F.col("own_key"), F.col("value")))))
    wrong = F.coalesce(F.col("computed") != F.col("crc"), F.lit(False))
    status = F.when(F.col("there").isNull(), "NotFound: No record").when(~F.coalesce(fits, F.lit(False)), "Corruption: Value size").when(wrong, "Corruption: Checksum").otherwise("OK")
    return rows.select("db_id", "key", status.alias("status"), F.when(fits & ~wrong, F.col("value")).alias("value"))


def lookups(wal: DataFrame) -> DataFrame:
    """The mutations of a log with repeats, as puts and deletes of (db_id, key)."""
    return wal.where(readable() & F.col("vtype").isin(PUT, DELETE))
