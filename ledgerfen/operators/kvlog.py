"""What the log, table and listing rows of the store mean; shared by the operators on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = 1, 2
#: Bytes of a log record besides its key, by kind.
PUT_BYTES, DELETE_BYTES = 29, 13

POINTER = ["file_id", "offset", "value_size"]


def readable(key: str = "key", seq: str = "seq", vtype: str = "vtype", length: str = "len") -> Column:
    """True for a record that isn't torn: key, seq and vtype are there and the stated length fits; never null."""
    size = F.octet_length(F.col(key)) + F.when(F.col(vtype) == PUT, PUT_BYTES).when(F.col(vtype) == DELETE, DELETE_BYTES)
    return F.coalesce(F.col(seq).isNotNull() & (F.col(length) == size), F.lit(False))


def latest_listing(manifest: DataFrame) -> DataFrame:
    """One row for each (db_id, file_id): that of the greatest listed_at.

    Null listed_at comes last; among rows of the same listed_at the greater removed_at, level, created_at and so on wins, so
    the choice never depends on the order of the rows. Rows without db_id or file_id are no listings and are left out.
    """
    fields = ["listed_at", "removed_at", "level", "created_at", "num_entries", "file_size", "smallest_key", "largest_key"]
    latest = F.max(F.struct(*fields)).alias("row")
    rows = manifest.where("db_id IS NOT NULL AND file_id IS NOT NULL")
    return rows.groupBy("db_id", "file_id").agg(latest).select("db_id", "file_id", *(f"row.{c}" for c in fields))


def pointer_of_puts() -> list[Column]:
    """The pointer columns, null unless the row is a put."""
    return [F.when(F.col("vtype") == PUT, F.col(c)).alias(c) for c in POINTER]
