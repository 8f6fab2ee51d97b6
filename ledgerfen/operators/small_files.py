"""Far too many small files: find them, plan fewer files, rewrite the partitions concerned and nothing else.

The method is partition-local compaction. A partition is a (db_id, level). ``find_small_files`` lists the small files of the
partitions that have at least ``min_files`` of them; ``plan_merges`` packs those files into new ones; ``rewrite`` gives the
entries of the new files. ``SnapshotStore`` keeps a store of entries, partitioned on disk, in numbered versions. ``compact``
reads one version and replaces only the partitions concerned, as a dynamic overwrite does: those that are in the rows written.
The old ones stay as they were for readers of earlier versions, and a change that was computed from a version in which one of
its partitions has since been replaced is refused.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import if_small, materialize
from ..sources.commits import Commits, Taken
from .kvlog import POINTER, latest_listing
from .ordered import numbered

SMALL_BYTES = 4096
TARGET_BYTES = 4 << 20
INDEX_INTERVAL = 16
#: Small files that one packing task handles, about; the number of packing tasks follows from it.
FILES_PER_LANE = 20_000

ENTRY = ["key", "vtype", "seq", *POINTER]


def key_bytes() -> Column:
    return F.coalesce(F.octet_length("key"), F.lit(0)).cast("long")


def entry_bytes() -> Column:
    """Bytes of an entry: key length prefix of one byte, or two from 128 on, the key and 25 fixed bytes."""
    return key_bytes() + F.when(key_bytes() >= 128, 2).otherwise(1) + 25


def index_bytes() -> Column:
    """Bytes of an entry in the file's index, which has every sixteenth."""
    return F.when(F.col("pos") % INDEX_INTERVAL == 0, entry_bytes() - 25 + 8).otherwise(0)


def file_bytes(body: Column, entries: Column) -> Column:
    """Bytes of a file from those of its entries and index: filter block, footer and what they count."""
    bits = F.greatest(F.lit(64).cast("long"), entries * 10)
    return body + F.ceil(bits / 8).cast("long") + 4 + 48


def true_sizes(sst: DataFrame) -> DataFrame:
    """(db_id, sst_id, entries, bytes) of each file, from its distinct entries.

    Repeated rows count once, whatever other columns they have. A null key counts as an empty one. The first aggregation is on the whole entry and the second
    adds up partial sums, so no file, however large, is gathered in a task.
    """
    entries = sst.where("db_id IS NOT NULL AND sst_id IS NOT NULL").select("db_id", "sst_id", "pos", *ENTRY).distinct()
    return (
        entries.groupBy("db_id", "sst_id")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum(entry_bytes() + index_bytes()).alias("body"))
        .select("db_id", "sst_id", "entries", file_bytes(F.col("body"), F.col("entries")).alias("bytes"))
    )


def find_small_files(manifest: DataFrame, sst: DataFrame, small_bytes: int = SMALL_BYTES, min_files: int = 2) -> DataFrame:
    """(db_id, level, file_id, entries, bytes, smallest_key) of the small current files of partitions with ``min_files`` of them.

    A file is current when its last listing has no removed_at; its level is that listing's. Sizes are computed from the
    entries, as listed sizes may be null or wrong; a file without entries is as large as an empty one. Files of null level
    form a partition of their own.
    """
    current = current_files(manifest)
    sizes = true_sizes(of_files(sst, current, manifest.count())).withColumnRenamed("sst_id", "file_id")
    return small_of(listed_sizes(current, sizes), small_bytes, min_files)


def current_files(manifest: DataFrame) -> DataFrame:
    return latest_listing(manifest).where("removed_at IS NULL").select("db_id", "file_id", "level", "smallest_key")


def of_files(sst: DataFrame, files: DataFrame, count: int) -> DataFrame:
    """The rows of ``sst`` of the files listed, of which there are at most ``count``; removed files' rows go no further than the scan."""
    here = files.select(F.col("db_id").alias("_db"), F.col("file_id").alias("_file"))
    return sst.join(if_small(here, count), (F.col("db_id") == F.col("_db")) & (F.col("sst_id") == F.col("_file")), "left_semi")


def listed_sizes(current: DataFrame, sizes: DataFrame) -> DataFrame:
    """``current`` with the files' entries and bytes; a file without entries is as large as an empty one."""
    empty = file_bytes(F.lit(0).cast("long"), F.lit(0).cast("long"))
    both = current.join(sizes.select("db_id", "file_id", "entries", "bytes"), ["db_id", "file_id"], "left")
    return both.withColumns({"entries": F.coalesce("entries", F.lit(0)), "bytes": F.coalesce("bytes", empty)})


def small_of(files: DataFrame, small_bytes: int, min_files: int) -> DataFrame:
    """The files under ``small_bytes`` of the partitions that have ``min_files`` of them."""
    small = files.where(F.col("bytes") < small_bytes)
    counts = small.groupBy("db_id", "level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_files)
    counts = counts.select(F.col("db_id").alias("_db"), F.col("level").alias("_level"))
    same = (F.col("db_id") == F.col("_db")) & F.col("level").eqNullSafe(F.col("_level"))
    return small.join(counts, same, "left_semi").select("db_id", "level", "file_id", "entries", "bytes", "smallest_key")


def plan_merges(small: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(db_id, level, file_id, bytes, lane, bin): small files with the same (db_id, level, lane, bin) become one file.

    The files are range-partitioned in key order into lanes of bounded length, which are written down, as their limits come
    from a sample; within a lane they are packed in order. So each new file has at most ``target_bytes`` plus one small file,
    and all but the last of a lane have at least ``target_bytes``.
    """
    small = materialize(small, "small-files")
    lanes = max(1, -(-small.count() // FILES_PER_LANE))
    ordered = small.repartitionByRange(lanes, "db_id", "level", "smallest_key", "file_id")
    ordered = materialize(ordered.withColumn("lane", F.spark_partition_id()), "lanes")
    before = W.partitionBy("db_id", "level", "lane").orderBy("smallest_key", "file_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    return ordered.select("db_id", "level", "file_id", "bytes", "lane", F.floor(start / target_bytes).cast("long").alias("bin"))


def rewrite(sst: DataFrame, plan: DataFrame) -> DataFrame:
    """(db_id, level, lane, bin, pos, key, vtype, seq, pointer) of the new files, every distinct entry of the old files once.

    In each new file the entries are in the order of their keys, newest first, and are numbered from 0.
    """
    entries = sst.select("db_id", F.col("sst_id").alias("file_id_"), "pos", *ENTRY)
    files = plan.select(F.col("db_id").alias("db_"), F.col("file_id").alias("old_file"), "level", "lane", "bin")
    files = if_small(files, plan.count())
    moved = entries.join(files, (F.col("db_id") == F.col("db_")) & (F.col("file_id_") == F.col("old_file"))).distinct()
    order = W.partitionBy("db_id", "level", "lane", "bin").orderBy("key", F.desc("seq"), "old_file", "pos", *ENTRY[1:])
    pos = (F.row_number().over(order) - 1).cast("long").alias("pos")
    return moved.select("db_id", "level", "lane", "bin", pos, *ENTRY)


class ConflictError(RuntimeError):
    """Someone else replaced a partition since the version that this change was computed from."""


_ROWS = "sst_id long, pos long, key string, vtype int, seq long, file_id long, offset long, value_size long"
_FILES = "db_id long, level int, file_id long, entries long, bytes long, smallest_key string"
#: Every so many versions the commit names all partitions and not only those changed.
_WHOLE = 16


def _partition() -> Column:
    """A partition's name, as parts of a path."""
    level = F.coalesce(F.col("level").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return F.concat(F.lit("db_id="), F.col("db_id").cast("string"), F.lit("/level="), level)


class SnapshotStore:
    """Entries in parquet under ``path``, partitioned by (db_id, level), with numbered versions.

    A change is written in full to a folder of its own, ``path/rows/change=<id>``, with its files' sizes in ``path/files``.
    Then a commit maps its partitions to that folder; the other partitions stay where they are. Folders are never written
    again, so whoever reads a version sees it whole for as long as it is kept, and a writer that dies leaves only a folder
    that no version names. ``expire`` deletes the folders of old versions. A level can be null; rows without database aren't kept.
    """

    SPEC = ["db_id", "level"]

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._commits, self._numbers = Commits(spark, f"{path}/versions"), Commits(spark, f"{path}/numbers")

    def version(self) -> int:
        return self._commits.last()

    def _partitions(self, version: int) -> dict[str, str]:
        """Of each partition of a version the folder that has it."""
        changes = []
        for n in range(version, 0, -1):
            changes.append(self._commits.read(n))
            if "all" in changes[-1]:
                break
        now: dict[str, str | None] = {}
        for c in reversed(changes):
            now = dict(c["all"]) if "all" in c else now | c["changed"]
        return {p: at for p, at in now.items() if at}

    def changed_since(self, version: int) -> set[str]:
        """The partitions changed by later versions."""
        return {p for n in range(version + 1, self.version() + 1) for p in self._commits.read(n)["changed"]}

    def _folders(self, version: int | None) -> dict[str, list[str]]:
        """Of each folder that a version reads its partitions that count."""
        folders: dict[str, list[str]] = {}
        for p, at in self._partitions(self.version() if version is None else version).items():
            folders.setdefault(at, []).append(p)
        return folders

    def _on_disk(self, at: str) -> set[str]:
        """The partitions that a folder has, as parts of a path."""
        if not self._fs.exists(self._fs_path(at)):
            return set()
        below = lambda path: [x.getPath() for x in self._fs.listStatus(path) if x.getPath().getName().startswith(("db_id=", "level="))]
        return {f"{d.getName()}/{x.getName()}" for d in below(self._fs_path(at)) for x in below(d)}

    def read(self, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """(db_id, level, sst_id, pos, entry) of a version, the last one by default; of the partitions ``only``, when given."""
        root, paths = f"{self.path}/rows", []
        for at, have in self._folders(version).items():
            there, have = self._on_disk(f"{root}/change={at}"), {p for p in have if only is None or p in only}
            # a folder that is read in whole is one path
            paths += ([f"{root}/change={at}"] if there <= have else [f"{root}/change={at}/{p}" for p in sorted(have & there)]) if there else []
        schema = f"{_ROWS}, change string, db_id long, level int"
        rows = self.spark.read.option("basePath", root).schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.select(*self.SPEC, "sst_id", "pos", *ENTRY)

    def files(self, version: int | None = None) -> DataFrame:
        """(db_id, level, file_id, entries, bytes, smallest_key) of the files of a version."""
        root, folders = f"{self.path}/files", self._folders(version)
        schema = f"{_FILES}, change string"
        if not folders:
            return self.spark.createDataFrame([], schema).drop("change")
        rows = self.spark.read.option("basePath", root).schema(schema).parquet(*(f"{root}/change={at}" for at in folders))
        # a row for each partition of the version
        now = self.spark.createDataFrame([(at, p) for at, have in folders.items() for p in have], "_change string, _partition string")
        return rows.join(if_small(now, now.count()), (F.col("change") == F.col("_change")) & (_partition() == F.col("_partition")), "left_semi").drop("change")

    def commit(self, rows: DataFrame, base: int, files: DataFrame | None = None, touched: set[str] = frozenset()) -> int:
        """Replace the partitions in ``rows`` by ``rows``, which were computed from version ``base``; the new version's number.

        ``files`` (db_id, level, file_id, smallest_key) lists the files when empty ones are among them. Partitions ``touched`` that aren't in ``rows`` or
        ``files`` are gone. Another writer's version in between is no conflict when it is about other partitions.
        """
        at = uuid.uuid4().hex
        rows = rows.where("db_id IS NOT NULL").select(*self.SPEC, "sst_id", "pos", *ENTRY)
        # a partition's rows are in one task, or in several of the advisory size when it is large: few files, none of them huge
        gathered = rows.hint("rebalance", *self.SPEC).sortWithinPartitions(*self.SPEC, "sst_id", "pos")
        gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.SPEC).parquet(f"{self.path}/rows/change={at}")
        own = self._written(at).groupBy(*self.SPEC, F.col("sst_id").alias("file_id")).agg(F.count(F.lit(1)).alias("entries"), F.sum(entry_bytes() + index_bytes()).alias("body"), F.min("key").alias("smallest_key"))
        own = own.withColumn("bytes", file_bytes(F.col("body"), F.col("entries")))
        own = own if files is None else listed_sizes(files, own)
        listed = f"{self.path}/files/change={at}"
        own.select(*self.SPEC, "file_id", "entries", "bytes", "smallest_key").write.parquet(listed)
        have = {r.p for r in self.spark.read.schema(_FILES).parquet(listed).select(_partition().alias("p")).distinct().collect()}
        changed = {p: at for p in have} | {p: None for p in touched - have}
        while True:
            last = self.version()
            if (clash := self.changed_since(base) & set(changed)):
                raise ConflictError(f"changed since version {base}: {sorted(clash)[:5]}")
            content: dict = {"changed": changed}
            if (last + 1) % _WHOLE == 0:
                content["all"] = self._partitions(last) | changed
            try:
                self._commits.create(last + 1, content)
                return last + 1
            except Taken:
                continue  # another writer was faster: is it about the same partitions?

    def _written(self, at: str) -> DataFrame:
        return self.spark.read.schema(f"{_ROWS}, db_id long, level int").parquet(f"{self.path}/rows/change={at}")

    def reserve(self, count: int) -> int:
        """The first of ``count`` file numbers that no other writer gets."""
        while True:
            last = self._numbers.last()
            first = self._numbers.read(last)["next"] if last else 1 + (self.files().agg(F.max("file_id")).first()[0] or 0)
            try:
                self._numbers.create(last + 1, {"next": first + count})
                return first
            except Taken:
                continue

    def expire(self, keep: int = 2, grace_seconds: float = 24 * 3600) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions names and that are older than the grace period.

        The grace period must be longer than any change takes to write, as a folder is named only in the end.
        """
        last = self.version()
        named = {at for n in range(max(1, last - keep + 1), last + 1) for at in self._partitions(n).values()}
        gone = []
        for kind in ("rows", "files"):
            root = self._fs_path(f"{self.path}/{kind}")
            for x in self._fs.listStatus(root) if self._fs.exists(root) else ():
                at = x.getPath().getName().removeprefix("change=")
                if at not in named and x.getModificationTime() <= (time.time() - grace_seconds) * 1000:
                    self._fs.delete(x.getPath(), True)
                    gone.append(at)
        return sorted(set(gone))


def load(store: SnapshotStore, sst: DataFrame, manifest: DataFrame) -> int:
    """Put the current files of a listing into an empty store, each entry once, in the level of its file's listing."""
    current = materialize(current_files(manifest), "current")
    count = current.count()
    level = if_small(current.select(F.col("db_id").alias("_db"), F.col("file_id").alias("_file"), F.col("level").alias("_level")), count)
    own = sst.select("db_id", "sst_id", "pos", *ENTRY).join(level, (F.col("db_id") == F.col("_db")) & (F.col("sst_id") == F.col("_file")))
    return store.commit(own.select("db_id", F.col("_level").alias("level"), "sst_id", "pos", *ENTRY).distinct(), 0, files=current)


def compact(store: SnapshotStore, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, min_files: int = 2) -> tuple[DataFrame, int]:
    """Rewrite the partitions of ``store`` that have too many small files; (the files replaced, the new version).

    What is rewritten is read from the store itself, at the version that the change is then checked against. The other files
    of a rewritten partition are kept as they are. New files have numbers that no other file of the store has. With nothing to
    do the version stays.
    """
    base = store.version()
    plan = materialize(plan_merges(small_of(store.files(base), small_bytes, min_files), target_bytes), "plan")
    replaced = plan.select("db_id", "level", "file_id", "bytes")
    bins = plan.select("db_id", "level", "lane", "bin").distinct()
    count = bins.count()
    if not count:
        return replaced, base
    first = store.reserve(count)
    names = materialize(numbered(bins, ["db_id", "level", "lane", "bin"], "no").withColumn("new_id", F.col("no") + first - 1), "names")
    same = (F.col("p.db_id") == F.col("n.db_id")) & F.col("p.level").eqNullSafe(F.col("n.level")) & (F.col("p.lane") == F.col("n.lane")) & (F.col("p.bin") == F.col("n.bin"))
    moves = plan.alias("p").join(if_small(names, count).alias("n"), same).select(F.col("p.db_id").alias("_db"), F.col("p.file_id").alias("_file"), "new_id")
    moves = if_small(materialize(moves, "moves"), plan.count())
    touched = {r.p for r in plan.select(_partition().alias("p")).distinct().collect()}
    old = store.read(base, touched)
    mine = (F.col("db_id") == F.col("_db")) & (F.col("sst_id") == F.col("_file"))
    kept = old.join(moves, mine, "left_anti")
    # a new file has the target's bytes and one small file more at most
    order = W.partitionBy("db_id", "level", "new_id").orderBy("key", F.desc("seq"), "sst_id", "pos", *ENTRY[1:])
    new = old.join(moves, mine).withColumn("_pos", (F.row_number().over(order) - 1).cast("long"))
    new = new.select("db_id", "level", F.col("new_id").alias("sst_id"), F.col("_pos").alias("pos"), *ENTRY)
    return replaced, store.commit(kept.select(new.columns).unionByName(new), base, touched=touched)
