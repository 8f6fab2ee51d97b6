"""Processing only new or changed records: processed sequence numbers as disjoint intervals.

A mutation can be logged again under its number with other contents, so the contents of a number are numbered in the order in
which they appeared (``version``), and there is a set of intervals for each (feed, db_id, version). Intervals are cut at
multiples of ``BLOCK``, so that all steps after the merging of repeats are local to a (feed, db_id, block) and share one
shuffle, whose groups are small however large a database is.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import if_small
from ..sources.commits import Commits
from .kvlog import POINTER, latest_listing, pointer_of_puts, readable

#: Sequence numbers in a block.
BLOCK = 4096

CONTENT = ["key", "vtype", *POINTER]
GROUP = ["feed", "db_id", "version", "block"]


def block_of(seq: str = "seq") -> Column:
    return F.floor(F.col(seq) / BLOCK).cast("long")


def wal_contents(wal: DataFrame) -> DataFrame:
    """(feed, db_id, seq, content, seen_at) of the readable records; torn ones have no contents. Rows without arrived_at haven't appeared."""
    rows = wal.where(readable()).where("db_id IS NOT NULL AND arrived_at IS NOT NULL")
    return rows.select(F.lit("wal").alias("feed"), "db_id", "seq", "key", "vtype", *pointer_of_puts(), F.col("arrived_at").alias("seen_at"))


def sst_contents(sst: DataFrame, manifest: DataFrame) -> DataFrame:
    """(feed, db_id, seq, content, seen_at) of the entries of listed files, removed ones too; entries of unlisted files haven't appeared."""
    files = latest_listing(manifest).where("created_at IS NOT NULL").select(F.col("db_id").alias("db_"), F.col("file_id").alias("file_"), F.col("created_at").alias("seen_at"))
    rows = sst.where("seq IS NOT NULL").select("db_id", "sst_id", "seq", "key", "vtype", *pointer_of_puts())
    rows = rows.join(if_small(files, manifest.count()), (F.col("db_id") == F.col("db_")) & (F.col("sst_id") == F.col("file_")))
    return rows.select(F.lit("sst").alias("feed"), "db_id", "seq", *CONTENT, "seen_at")


def versioned(contents: DataFrame) -> DataFrame:
    """(feed, db_id, block, seq, version, seen_at): each distinct content once, with its first appearance and its number from 0.

    Contents of one number that appeared at the same time are numbered in the order of their hashes. The rows come out
    partitioned by (feed, db_id, block), which all later steps use.
    """
    rows = contents.withColumn("block", block_of())
    # repeats are merged first, on the whole content, so that no number is hot; what then goes to the blocks has a hash for
    # the content, which only orders contents of the same time
    first = rows.groupBy("feed", "db_id", "block", "seq", *CONTENT).agg(F.min("seen_at").alias("seen_at"))
    first = first.select("feed", "db_id", "block", "seq", "seen_at", F.xxhash64(*CONTENT).alias("content")).repartition("feed", "db_id", "block")
    order = W.partitionBy("feed", "db_id", "block", "seq").orderBy("seen_at", "content")
    return first.select("feed", "db_id", "block", "seq", (F.row_number().over(order) - 1).alias("version"), "seen_at")


def to_intervals(numbers: DataFrame) -> DataFrame:
    """(feed, db_id, version, block, lo, hi): the fewest disjoint intervals of the numbers, which may repeat, within blocks."""
    w = W.partitionBy(*GROUP).orderBy("seq")
    islands = numbers.select(*GROUP, "seq", (F.col("seq") - F.dense_rank().over(w)).alias("island"))
    return islands.groupBy(*GROUP, "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("island")


def subtract(available: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows (feed, db_id, block, seq, version) of ``available`` that no interval covers.

    An as-of look-up within the block: intervals and numbers are sorted together, and the last interval begun decides.
    ``intervals`` must be disjoint.
    """
    rows = available.select(*GROUP, "seq", F.lit(1).alias("row"), F.lit(None).cast("long").alias("hi"))
    marks = intervals.select(*GROUP, F.col("lo").alias("seq"), F.lit(0).alias("row"), "hi")
    w = W.partitionBy(*GROUP).orderBy("seq", "row").rowsBetween(W.unboundedPreceding, 0)
    reach = rows.unionByName(marks).withColumn("reach", F.last("hi", ignorenulls=True).over(w))
    return reach.where("row = 1 AND (reach IS NULL OR reach < seq)").select(*GROUP, "seq")


def good_reads(run_log: DataFrame) -> DataFrame:
    """(feed, read_at) of the good runs.

    Of the rows of a run the one with the greatest recorded_at counts (null first; ties by the other fields). A run without
    run_id, feed or read_at is no run.
    """
    fields = ["recorded_at", "finished_at", "read_at", "feed", "status"]
    last = run_log.where("run_id IS NOT NULL").groupBy("run_id").agg(F.max(F.struct(*fields)).alias("r")).select("r.*")
    good = (F.lower(F.trim("status")) == "succeeded") & F.col("finished_at").isNotNull() & F.col("feed").isNotNull()
    return last.where(good & F.col("read_at").isNotNull()).select("feed", "read_at")


def last_good_reads(run_log: DataFrame) -> DataFrame:
    """(feed, read_to): the greatest read_at of the good runs of each feed."""
    return good_reads(run_log).groupBy("feed").agg(F.max("read_at").alias("read_to"))


def pending(contents: DataFrame, run_log: DataFrame) -> DataFrame:
    """(feed, db_id, seq) of the mutations that no good run has handled, each once.

    The intervals of the handled contents are rebuilt from the run log: a good run handled all that had appeared when it
    read. They are subtracted from what is there now, so numbers in gaps, late ones and corrected ones come out whatever
    their place. Feeds without a good run come out whole.
    """
    reads = if_small(last_good_reads(run_log).withColumnRenamed("feed", "feed_"), run_log.count())
    rows = versioned(contents).join(reads, F.col("feed") == F.col("feed_"), "left")
    done = to_intervals(rows.where(F.col("seen_at") <= F.col("read_to")))
    return subtract(rows, done).select("feed", "db_id", "block", "seq").distinct().select("feed", "db_id", "seq")


_BLOCK = ["feed", "db_id", "block"]
_STATE = "feed string, db_id long, version int, block long, lo long, hi long, contents array<bigint>, run long"
_MARKS = "feed string, db_id long, block long, n long, digest long, run long"
#: Runs whose intervals lie beside each other before they are written as one.
MERGE_RUNS = 16


def content_hash() -> Column:
    return F.xxhash64(*CONTENT)


class IntervalLedger:
    """Intervals of the processed numbers in a folder, committed together with each run's output.

    ``path/run=<n>-<id>`` holds ``output``, ``intervals`` and ``blocks``; a run counts once the commit of its number, which only
    one run can create, names it. Whatever a failed run has written is never named.

    A content keeps the version under which it was first processed: an interval has the hashes of its numbers' contents, eight
    bytes a number, in their order. So a content that arrives late with an earlier time gets a version of its own, and none is
    handed over twice or not at all. ``blocks`` has the number of rows and a digest of each block as it was; a run reads the
    intervals of the blocks that differ, and writes no others.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._commits = Commits(spark, f"{path}/commits")

    def _named(self) -> list[str]:
        last = self._commits.last()
        return self._commits.read(last)["runs"] if last else []

    def _newest(self, kind: str, schema: str, of: DataFrame | None = None) -> DataFrame:
        """Each block's rows from the last run that wrote it; of the blocks ``of``, when given."""
        at = [f"{self.path}/{r}/{kind}" for r in self._named()]
        rows = self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)
        if of is not None:
            rows = _of_blocks(rows, of)
        last = rows.groupBy(*_BLOCK).agg(F.max("run").alias("_run")).select(*(F.col(c).alias(f"_{c}") for c in _BLOCK), "_run")
        return rows.join(last, _same_block() & (F.col("run") == F.col("_run")), "left_semi")

    def intervals(self) -> DataFrame:
        """(feed, db_id, version, block, lo, hi, contents) of all that is processed."""
        return self._newest("intervals", _STATE).drop("run")

    def run(self, contents: DataFrame, fail_before_commit: bool = False) -> DataFrame:
        """Hand over what isn't processed yet and commit it: (feed, db_id, seq, version, content, seen_at), each content once."""
        no = self._commits.last()
        at = f"{self.path}/run={no + 1}-{uuid.uuid4().hex}"
        rows = contents.where("seq IS NOT NULL").select("feed", "db_id", block_of().alias("block"), "seq", *CONTENT, "seen_at")
        # blocks whose rows are the same as at the last run have nothing new; repeats count, so that no change is missed
        marks = rows.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("seq", *CONTENT)).alias("digest"))
        then = self._newest("blocks", _MARKS).select(*(F.col(c).alias(f"_{c}") for c in _BLOCK), F.col("n").alias("_n"), F.col("digest").alias("_digest"))
        differs = F.col("_n").isNull() | (F.col("n") != F.col("_n")) | (F.col("digest") != F.col("_digest"))
        marks.join(then, _same_block(), "left").where(differs).select(*marks.columns, F.lit(no + 1).cast("long").alias("run")).write.parquet(f"{at}/blocks")
        touched = self.spark.read.schema(_MARKS).parquet(f"{at}/blocks").select(*_BLOCK)
        touched = if_small(touched, touched.count())

        first = _of_blocks(rows, touched).groupBy(*_BLOCK, "seq", *CONTENT).agg(F.min("seen_at").alias("seen_at"))
        first = first.withColumns({"content": content_hash(), "version": F.lit(None).cast("int"), "new": F.lit(1)})
        known = self._newest("intervals", _STATE, touched).select(*_BLOCK, "version", F.col("lo"), F.posexplode("contents").alias("i", "content"))
        known = known.select(*_BLOCK, (F.col("lo") + F.col("i")).alias("seq"), "version", "content", F.lit(0).alias("new"))
        # all that follows is local to a block
        both = first.unionByName(known, allowMissingColumns=True).repartition(*_BLOCK)
        done = F.min("new").over(W.partitionBy(*_BLOCK, "seq", "content")) == 0
        both = both.withColumn("done", done).where("new = 0 OR NOT done")
        order = W.partitionBy(*_BLOCK, "seq").orderBy("new", "version", "seen_at", "content")
        both = both.withColumn("version", F.row_number().over(order) - 1)
        both.where("new = 1").select("feed", "db_id", "seq", "version", *CONTENT, "seen_at").write.parquet(f"{at}/output")
        # what is committed as processed is what the written output holds, not what a second evaluation would give
        out = self.spark.read.parquet(f"{at}/output")
        after = known.drop("new").unionByName(out.select("feed", "db_id", block_of().alias("block"), "seq", "version", content_hash().alias("content")))
        with_contents(after).withColumn("run", F.lit(no + 1).cast("long")).write.parquet(f"{at}/intervals")
        runs = [*self._named(), at.rsplit("/", 1)[1]]
        if len(runs) > MERGE_RUNS:
            runs = [self._merged(runs, at)]
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        self._commits.create(no + 1, {"runs": runs, "output": at})  # fails when another run was faster
        return out

    def _merged(self, runs: list[str], at: str) -> str:
        """The state of ``runs`` as one folder in that of the newest."""
        self_at = f"{at}/merged"
        named, self._named = self._named, lambda: runs
        try:
            self._newest("intervals", _STATE).write.parquet(f"{self_at}/intervals")
            self._newest("blocks", _MARKS).write.parquet(f"{self_at}/blocks")
        finally:
            self._named = named
        return f"{at.rsplit('/', 1)[1]}/merged"


def _same_block() -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _BLOCK))


def _of_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of the blocks. A hint on ``blocks`` is kept, as only columns are renamed."""
    return rows.join(blocks.select(*(F.col(c).alias(f"_{c}") for c in _BLOCK)), _same_block(), "left_semi")


def with_contents(numbers: DataFrame) -> DataFrame:
    """(feed, db_id, version, block, lo, hi, contents): disjoint intervals of (feed, db_id, version, block, seq, content), with
    the contents of their numbers in order. A number has one content for each version."""
    w = W.partitionBy(*GROUP).orderBy("seq")
    islands = numbers.select(*GROUP, "seq", "content", (F.col("seq") - F.row_number().over(w)).alias("island"))
    own = islands.groupBy(*GROUP, "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    return own.select(*GROUP, "lo", "hi", F.col("c.content").alias("contents"))
