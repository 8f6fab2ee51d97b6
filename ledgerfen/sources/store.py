"""Table files and listings: sorted parquet with key filters, and listings as text that appear whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits


def write_sorted(entries: DataFrame, path: str, files: int, key: str = "key") -> None:
    """Entries in ``files`` files of disjoint key ranges, sorted, with minima, maxima and a Bloom filter of the keys for each."""
    rows = entries.repartitionByRange(files, key).sortWithinPartitions(key)
    rows.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def unsorted(entries: DataFrame, file: list[str]) -> DataFrame:
    """(file, bad): how many entries of a file have a smaller key than the one before; none in a well-formed file."""
    from pyspark.sql import Window as W

    before = F.lag("key").over(W.partitionBy(*file).orderBy("pos"))
    return entries.withColumn("_before", before).groupBy(*file).agg(F.count_if(F.col("_before") > F.col("key")).alias("bad"))


def manifest_lines(listing: DataFrame) -> DataFrame:
    """(db_id, line) of a listing: number, level, entries, smallest and largest key, between tabs.

    Backslash, tab and line ends in keys are escaped, so that every key, the empty one too, survives.
    """
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n")
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file_id", "level", "num_entries")]
    return listing.select("db_id", F.concat_ws("\t", *cols, F.coalesce(safe("smallest_key"), F.lit("")), F.coalesce(safe("largest_key"), F.lit(""))).alias("line"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """The listing of lines; lines without five fields are left out."""
    parts = F.split("line", "\t", -1)

    def back(c):
        marked = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
        return F.replace(F.replace(F.replace(marked, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))

    rows = lines.withColumn("p", parts).where(F.size("p") == 5)
    number = lambda i: F.expr(f"try_cast(p[{i}] AS bigint)")
    return rows.select("db_id", number(0).alias("file_id"), number(1).cast("int").alias("level"), number(2).alias("num_entries"), back(F.col("p")[3]).alias("smallest_key"), back(F.col("p")[4]).alias("largest_key"))


def save_manifest(listing: DataFrame, path: str) -> int:
    """The listing as text files under ``path``; the number of its version.

    It is written to a folder of its own, which a commit then names, so readers see the old listing or the new one, whatever
    fails. Of two writers at once one is refused.
    """
    commits = Commits(listing.sparkSession, f"{path}/versions")
    last, folder = commits.last(), f"listing-{uuid.uuid4().hex}"
    manifest_lines(listing).write.partitionBy("db_id").text(f"{path}/{folder}")
    commits.create(last + 1, {"folder": folder})
    return last + 1


def load_manifest(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """The listing under ``path``; files that aren't in ``existing`` (db_id, file_id), when given, are skipped."""
    commits = Commits(spark, f"{path}/versions")
    if not commits.last():
        raise FileNotFoundError(f"{path} has no listing")
    at = f"{path}/{commits.read(commits.last())['folder']}"
    rows = parse_manifest(spark.read.schema("value string, db_id bigint").text(at).withColumnRenamed("value", "line"))
    return rows if existing is None else rows.join(existing.select("db_id", "file_id").distinct(), ["db_id", "file_id"], "left_semi")
