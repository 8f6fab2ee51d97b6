"""References to records that do not exist: signed reference and existence counts per key, kept from change deltas.

Each reference adds one to its key's reference count at its time; a record that it may point to adds one to the key's existence
count when it appears and takes one away when it goes. All deltas are one stream in the order of time, existence before
references at the same moment. A reference is an orphan when, with its own delta taken in, its key has positive references and
no positive existence. ``orphans_as_of`` sums the counts up over the whole stream, ``CountLedger`` from run to run, and
``orphans`` reads the report of the moment off the counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import if_small
from ..sources.commits import Commits
from .kvlog import POINTER, PUT, latest_listing, readable
from .ordered import running

KEY = ["db_id", *POINTER]
HOLDER = ["ref_table", "db_id", "holder_id", "row_no", "at"]
#: Runs whose counts lie beside each other before they are put together.
MERGE_RUNS = 8


def wal_references(wal: DataFrame) -> DataFrame:
    """(ref_table, db_id, holder_id, row_no, pointer, at) of the readable puts; those without a time haven't appeared."""
    rows = wal.where(readable() & (F.col("vtype") == PUT)).where("arrived_at IS NOT NULL")
    return rows.select(F.lit("wal").alias("ref_table"), "db_id", F.col("wal_id").alias("holder_id"), F.col("rec_no").alias("row_no"), *POINTER, F.col("arrived_at").alias("at"))


def sst_references(sst: DataFrame, manifest: DataFrame) -> DataFrame:
    """The same of the put entries, at the time their file was created; entries of unlisted files haven't appeared."""
    files = latest_listing(manifest).where("created_at IS NOT NULL").select(F.col("db_id").alias("db_"), F.col("file_id").alias("file_"), F.col("created_at").alias("at"))
    rows = sst.where(F.col("vtype") == PUT).select("db_id", "sst_id", "pos", *POINTER)
    rows = rows.join(if_small(files, manifest.count()), (F.col("db_id") == F.col("db_")) & (F.col("sst_id") == F.col("file_")))
    return rows.select(F.lit("sst").alias("ref_table"), "db_id", F.col("sst_id").alias("holder_id"), F.col("pos").alias("row_no"), *POINTER, "at")


def existence_deltas(vlog: DataFrame, segments: DataFrame) -> DataFrame:
    """(db_id, pointer, at, d_exist) of the records with a value: one at the arrival, minus one when the segment is dropped.

    A record that is there several times counts several times, up and down, which leaves the sign as it is. One that arrives
    after its segment was dropped is taken away before it comes, and never makes the count positive.
    """
    dropped = segments.where("dropped_at IS NOT NULL").groupBy("db_id", "file_id").agg(F.min("dropped_at").alias("gone"))
    dropped = if_small(dropped, segments.where("dropped_at IS NOT NULL").count())
    size = F.octet_length("value").cast("long").alias("value_size")
    rows = vlog.where("db_id IS NOT NULL AND file_id IS NOT NULL AND offset IS NOT NULL AND value IS NOT NULL AND arrived_at IS NOT NULL")
    rows = rows.select("db_id", "file_id", "offset", size, "arrived_at").join(dropped, ["db_id", "file_id"], "left")
    both = F.array(F.struct(F.col("arrived_at").alias("at"), F.lit(1).alias("d_exist")), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("d_exist")))
    return rows.select(*KEY, F.explode(both).alias("d")).select(*KEY, "d.at", "d.d_exist").where("at IS NOT NULL")


def deltas(references: DataFrame, existence: DataFrame) -> DataFrame:
    """(key, at, d_ref, d_exist, holder): both kinds of deltas as one stream; the holder is null in those of existence."""
    none = [F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("long").alias("holder_id"), F.lit(None).cast("long").alias("row_no")]
    return references.select(*KEY, "at", F.lit(1).alias("d_ref"), F.lit(0).alias("d_exist"), "ref_table", "holder_id", "row_no").unionByName(
        existence.select(*KEY, "at", F.lit(0).alias("d_ref"), "d_exist", *none)
    )


def orphans_as_of(stream: DataFrame) -> DataFrame:
    """(ref_table, db_id, holder_id, row_no, at) of the references that were orphans when they appeared.

    The running counts are worked out over ranges of (key, time), so a key that holds most of the stream is split like any
    other. A reference with a null in its pointer has a key for which nothing ever exists. Rows without a time have not
    appeared and count before all others.
    """
    counted = running(stream, KEY, ["at", "d_ref"], {"refs": ("sum", "d_ref"), "exist": ("sum", "d_exist")}, inclusive=True)
    return counted.where("ref_table IS NOT NULL AND refs > 0 AND exist <= 0").select(*HOLDER)


def merge_counts(counts: DataFrame | None, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, refs, exist): the counts so far with the deltas (keys, d_ref, d_exist) added; keys back at zero are left out.

    Null deltas count as zero. The order of the deltas doesn't matter, so they may come late.
    """
    rows = deltas.select(*keys, F.coalesce("d_ref", F.lit(0)).cast("long").alias("refs"), F.coalesce("d_exist", F.lit(0)).cast("long").alias("exist"))
    if counts is not None:
        rows = rows.unionByName(counts.select(*keys, "refs", "exist"))
    return rows.groupBy(*keys).agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).where("refs != 0 OR exist != 0")


def orphans(counts: DataFrame) -> DataFrame:
    """The keys with positive references and no existence."""
    return counts.where("refs > 0 AND exist <= 0")


class CountLedger:
    """The counts of the keys in a folder, committed together with each run's report.

    ``path/run=<id>`` holds ``counts``, what the run's deltas add up to, and ``report``, its orphans. A commit names the
    runs whose counts add up to the present ones; after ``MERGE_RUNS`` of them they are written as one. What a failed run has
    written is named by no commit.
    """

    _COUNTS = "db_id long, file_id long, offset long, value_size long, refs long, exist long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._commits = Commits(spark, f"{path}/commits")

    def _named(self) -> list[str]:
        last = self._commits.last()
        return self._commits.read(last)["runs"] if last else []

    def counts(self) -> DataFrame:
        """(key, refs, exist) of the committed runs."""
        return merge_counts(None, self._sums(self._named()).select(*KEY, F.col("refs").alias("d_ref"), F.col("exist").alias("d_exist")), KEY)

    def _sums(self, runs: list[str]) -> DataFrame:
        at = [f"{self.path}/{r}/counts" for r in runs]
        return self.spark.read.schema(self._COUNTS).parquet(*at) if at else self.spark.createDataFrame([], self._COUNTS)

    def run(self, stream: DataFrame, fail_before_commit: bool = False) -> DataFrame:
        """Take in the deltas that appeared since the last run; the orphans among their references.

        The counts so far come in as deltas before all others, those of the keys concerned only.
        """
        last, runs = self._commits.last(), self._named()
        name = f"run={uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        new = merge_counts(None, stream, KEY)
        new.write.parquet(f"{at}/counts")
        whole = stream
        if runs:
            keys = self.spark.read.schema(self._COUNTS).parquet(f"{at}/counts").select(*(F.col(k).alias(f"_{k}") for k in KEY))
            same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY))
            before = self._sums(runs).join(if_small(keys, keys.count()), same, "left_semi").groupBy(*KEY).agg(F.sum("refs").alias("d_ref"), F.sum("exist").alias("d_exist"))
            kind = dict(stream.dtypes)["at"]
            whole = stream.unionByName(before.withColumn("at", F.lit(None).cast(kind)), allowMissingColumns=True)
        orphans_as_of(whole).write.parquet(f"{at}/report")
        runs = [*runs, name]
        if len(runs) > MERGE_RUNS:
            merged = merge_counts(None, self._sums(runs).select(*KEY, F.col("refs").alias("d_ref"), F.col("exist").alias("d_exist")), KEY)
            runs = [f"{name}/merged"]
            merged.write.parquet(f"{self.path}/{runs[0]}/counts")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        self._commits.create(last + 1, {"runs": runs, "report": name})  # fails when another run was faster
        return self.spark.read.parquet(f"{at}/report")
