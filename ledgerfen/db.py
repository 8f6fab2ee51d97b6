"""A store in a folder, with the operations of an embedded key-value store; batches in, DataFrames out.

Keys and pointers are in ``index`` and values in ``values``, so that look-ups, compaction and liveness never read a value they
don't return. Each write is a folder of its own in both; a commit names the folders that make up the store, the next sequence
number and the end of the value log. A write that fails leaves folders that no commit names. All reads are of one commit.

Index folders are put together as they come (``maintain``, after each write): the newest ones, and older ones as long as they
aren't ten times as large. Folders and segments that are no longer named are deleted by ``expire``, after a grace period for
their readers.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import folds
from .operators.kvlog import DELETE, PUT
from .operators.ordered import numbered
from .operators.state import latest, live, status
from .session import if_small, materialize
from .sources.commits import Commits, Taken

INDEX = "seq long, key string, vtype int, file_id long, offset long, value_size long"
VALUES = "offset long, rec_size long, seq long, key string, value string, w string, file_id long"
POINTER = ["file_id", "offset", "value_size"]


@dataclass(frozen=True)
class Options:
    """``memtable_size_limit`` bounds what a ``Writer`` keeps, and the files that compaction writes, by entries' bytes.

    ``merge_folders`` new index folders are put together, with older ones less than ``growth`` times as large.
    """

    memtable_size_limit: int = 4 << 20
    merge_folders: int = 4
    growth: int = 10
    auto_maintain: bool = True
    vlog_file_size_limit: int = 256 << 20
    vlog_gc_threshold: float = 0.5
    bloom_filters: bool = True


class WriteBatch:
    """Puts and deletes in order; of the mutations of a key the later one wins."""

    def __init__(self) -> None:
        self.entries: list[tuple[int, str, str | None]] = []

    def put(self, key: str, value: str) -> WriteBatch:
        self.entries.append((1, key, value))
        return self

    def delete(self, key: str) -> WriteBatch:
        self.entries.append((2, key, None))
        return self

    def clear(self) -> None:
        self.entries.clear()

    def count(self) -> int:
        return len(self.entries)


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        """Opens the store at ``path``, or makes an empty one."""
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self._commits = Commits(spark, f"{self.path}/commits")

    # commits

    def _now(self) -> tuple[int, dict]:
        n = self._commits.last()
        empty = {"next_seq": 1, "file_id": 1, "offset": 0, "index": [], "values": [], "dropped": [], "streams": {}}
        return n, self._commits.read(n) if n else empty

    def _index(self, folders: list[list]) -> DataFrame:
        at = [f"{self.path}/index/{name}" for name, _ in folders]
        return self.spark.read.schema(INDEX).parquet(*at) if at else self.spark.createDataFrame([], INDEX)

    def _values(self, folders: list[str]) -> DataFrame:
        """A segment is a folder in each of the folders that have records of it."""
        root = f"{self.path}/values"
        if not folders:
            return self.spark.createDataFrame([], VALUES).drop("w")
        return self.spark.read.option("basePath", root).schema(VALUES).parquet(*(f"{root}/w={x}" for x in folders)).drop("w")

    def index(self) -> DataFrame:
        return self._index(self._now()[1]["index"])

    def values(self) -> DataFrame:
        return self._values_of(self._now()[1])

    def _values_of(self, now: dict) -> DataFrame:
        rows = self._values(now["values"])
        return rows.where(~F.col("file_id").isin(now["dropped"])) if now["dropped"] else rows

    # writing

    def put(self, key: str, value: str) -> None:
        self.write(WriteBatch().put(key, value))

    def delete(self, key: str) -> None:
        """A tombstone, whether the key is there or not."""
        self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch | DataFrame, stream: str | None = None, number: int | None = None) -> int:
        """Applies a batch as a whole; the number of its mutations.

        A DataFrame batch has (pos, vtype, key, value), pos being its total order. Null keys are refused, null values of puts
        are empty ones. Another writer's commit in between makes it fail, and nothing is applied. With the name of a
        ``stream`` and the ``number`` of its batch, batches up to that of the last commit are done and not applied again.
        """
        if isinstance(batch, WriteBatch):
            rows = [(i, *e) for i, e in enumerate(batch.entries)]
            batch = self.spark.createDataFrame(rows, "pos long, vtype int, key string, value string")
        n, now = self._now()
        if stream is not None:
            if self.done(stream, number):
                return 0
            now = now | {"streams": now["streams"] | {stream: number}}
        rows = batch.select("pos", "vtype", F.when(F.col("key").isNull(), F.raise_error("a key is null")).otherwise(F.col("key")).alias("key"), F.when(F.col("vtype") == PUT, F.coalesce("value", F.lit(""))).alias("value"))
        rows = materialize(numbered(rows, ["pos"], "seq").withColumn("seq", F.col("seq") + now["next_seq"] - 1), "batch")
        count = self._append(n, now, rows)
        if self.options.auto_maintain:
            self.maintain()
        return count

    def done(self, stream: str, number: int) -> bool:
        """Whether a stream's batch is in the store."""
        return self._now()[1]["streams"].get(stream, -1) >= number

    def _append(self, n: int, now: dict, rows: DataFrame, dropped: tuple = ()) -> int:
        """Commits (seq, key, vtype, value) rows, numbered from the next number on."""
        index, values = uuid.uuid4().hex, uuid.uuid4().hex
        first = (now["file_id"], now["offset"])
        placed = folds.vlog_layout(rows, self.options.vlog_file_size_limit, first=first, extra=("value",))
        placed.select("file_id", "offset", "rec_size", "seq", "key", "value").write.partitionBy("file_id").parquet(f"{self.path}/values/w={values}")
        there = self._values([values])
        pointers = there.select("seq", "file_id", "offset", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("value_size"))
        entries = rows.select("seq", "key", "vtype").join(pointers, "seq", "left").select("seq", "key", "vtype", *POINTER)
        self._sorted(entries, index)
        count = rows.count()
        end = there.agg(F.max(F.struct("file_id", (F.col("offset") + F.col("rec_size")).alias("end"))).alias("e")).first().e
        after = {
            "next_seq": now["next_seq"] + count, "file_id": end.file_id if end else now["file_id"], "offset": end.end if end else now["offset"],
            "index": [*now["index"], [index, count]], "values": [*now["values"], values], "dropped": [*now["dropped"], *dropped], "streams": now["streams"],
        }
        self._commits.create(n + 1, after)
        return count

    def writer(self) -> Writer:
        return Writer(self)

    def _sorted(self, entries: DataFrame, folder: str) -> None:
        at = f"{self.path}/index/{folder}"
        writer = entries.sortWithinPartitions("key", "seq").write
        if self.options.bloom_filters:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(at)

    # reading

    def get(self, key: str) -> str | None:
        """The value of a key, None when it isn't there.

        The filter on the key reaches the index files' statistics and Bloom filters; with the pointer found, the segment is a
        folder and the offset is another filter, so of the values one place is read.
        """
        now = self._now()[1]
        last = latest(self._index(now["index"]).where(F.col("key") == key), fields=["vtype", *POINTER]).first()
        if last is None or last.vtype != PUT:
            return None
        return self._values(now["values"]).where((F.col("file_id") == last.file_id) & (F.col("offset") == last.offset)).first().value

    def multi_get(self, wanted: DataFrame) -> DataFrame:
        """(key, status, value) of each distinct wanted key."""
        wanted = wanted.select("key").distinct()
        count = wanted.count()
        now = self._now()[1]
        last = latest(self._index(now["index"]).join(if_small(wanted, count), "key", "left_semi"), fields=["vtype", *POINTER])
        # no more pointers than wanted keys
        places = last.where(F.col("vtype") == PUT).select("file_id", "offset", F.col("key").alias("_key"))
        found = self._values_of(now).select("file_id", "offset", "value").join(if_small(places, count), ["file_id", "offset"]).select("_key", "value")
        both = wanted.join(last.select("key", "vtype"), "key", "left").join(found, F.col("key") == F.col("_key"), "left")
        return both.select("key", status(F.col("vtype")).alias("status"), "value")

    def entries(self) -> DataFrame:
        """(key, seq, pointer) of the live keys, without reading values."""
        return live(latest(self.index(), fields=["vtype", *POINTER])).select("key", "seq", *POINTER)

    def seek(self, target: str, reverse: bool = False) -> tuple[str, str] | None:
        """The first live key from ``target`` on with its value, or the last up to it; None when there is none."""
        rows = self.scan(**({"high": target} if reverse else {"low": target}), reverse=reverse)
        row = rows.first()
        return (row.key, row.value) if row else None

    def scan(self, low: str | None = None, high: str | None = None, prefix: str | None = None, reverse: bool = False) -> DataFrame:
        """(key, value) of the live keys in [low, high] and with ``prefix``, in key order or against it."""
        rows = self.index()
        for bound, test in ((low, F.col("key") >= F.lit(low)), (high, F.col("key") <= F.lit(high)), (prefix, F.col("key").startswith(F.lit(prefix or "")))):
            rows = rows if bound is None else rows.where(test)
        found = live(latest(rows, fields=["vtype", *POINTER]))
        return found.join(self.values().select("file_id", "offset", "value"), ["file_id", "offset"]).select("key", "value").orderBy(F.desc("key") if reverse else F.asc("key"))

    # maintenance

    def _due(self, folders: list[list]) -> int:
        """How many of the newest index folders are to be put together; 0 when there are too few new ones."""
        taken, total = 0, 0
        for _, size in reversed(folders):
            if taken and size > self.options.growth * max(total, 1):
                break
            taken, total = taken + 1, total + size
        return taken if taken >= self.options.merge_folders else 0

    def maintain(self) -> bool:
        """Puts index folders together when there are too many; whether it did. Another writer's commit in between cancels it.

        Deleted keys are still known as deleted afterwards; only ``compact_range`` forgets them.
        """
        n, now = self._now()
        taken = self._due(now["index"])
        try:
            return bool(taken) and self._merge(n, now, taken)
        except Taken:
            return False

    def _merge(self, n: int, now: dict, taken: int, purge: bool = False) -> bool:
        """The newest ``taken`` folders become one; without tombstones when ``purge``, which takes all folders."""
        old, new = now["index"][: len(now["index"]) - taken], now["index"][len(now["index"]) - taken :]
        last = latest(self._index(new), fields=["vtype", *POINTER])
        kept = materialize(live(last) if purge else last, "merged")
        sizes = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key") + 26).alias("bytes")).first()
        files = max(1, -(-(sizes.bytes or 0) // self.options.memtable_size_limit))
        index = uuid.uuid4().hex
        self._sorted(kept.select("seq", "key", "vtype", *POINTER).repartitionByRange(files, "key"), index)
        self._commits.create(n + 1, now | {"index": [*old, [index, sizes.n]]})
        return True

    def compact_range(self) -> None:
        """All index folders become one, of sorted files of disjoint key ranges, with a live entry for each live key only."""
        n, now = self._now()
        if now["index"]:
            self._merge(n, now, len(now["index"]), purge=True)

    def expire(self, keep: int = 1, grace_seconds: float = 24 * 3600) -> list[str]:
        """Deletes what none of the last ``keep`` commits names and is older than the grace period; what was deleted.

        These are index folders that were put together, folders of writes that failed, and the segments that were reclaimed.
        The grace period must be longer than any read or write takes.
        """
        last, gone = self._commits.last(), []
        named = [self._commits.read(n) for n in range(max(1, last - keep + 1), last + 1)]
        index = {name for c in named for name, _ in c["index"]}
        values = {x for c in named for x in c["values"]}
        dropped = set.intersection(*(set(c["dropped"]) for c in named)) if named else set()
        fs = self._commits._fs
        path = self._commits._path
        listed = lambda at: [x for x in fs.listStatus(path(at)) if x.isDirectory()] if fs.exists(path(at)) else []
        old = lambda x: x.getModificationTime() <= (time.time() - grace_seconds) * 1000
        for x in listed(f"{self.path}/index"):
            if x.getPath().getName() not in index and old(x):
                gone.append(x.getPath())
        for w in listed(f"{self.path}/values"):
            if w.getPath().getName().removeprefix("w=") not in values:
                gone += [w.getPath()] if old(w) else []
                continue
            for x in listed(w.getPath().toString()):
                number = x.getPath().getName().removeprefix("file_id=")
                if number.isdigit() and int(number) in dropped and old(x):
                    gone.append(x.getPath())
        for at in gone:
            fs.delete(at, True)
        return sorted(x.toString()[len(self.path) :].lstrip("/") if x.toString().startswith(self.path) else x.toString() for x in gone)

    def run_gc(self) -> int | None:
        """Drops the oldest segment but the last when enough of it is garbage, after its live records were put again.

        The number of the segment dropped; ``expire`` gives its space back. The records are put in the order of their offsets, with new numbers; as the commit
        must follow the one that was read, a key changed in between can't be put back.
        """
        n, now = self._now()
        segments = self._values_of(now).groupBy("file_id").agg(F.sum("rec_size").alias("total"))
        edge = segments.agg(F.min("file_id").alias("oldest")).first()
        if edge.oldest is None or edge.oldest >= now["file_id"]:
            return None
        old = self.values().where(F.col("file_id") == edge.oldest)
        kept = old.join(self.entries().select("key", "file_id", "offset"), ["key", "file_id", "offset"], "left_semi")
        total, used = old.agg(F.sum("rec_size")).first()[0], kept.agg(F.sum("rec_size")).first()[0] or 0
        if 1 - used / total < self.options.vlog_gc_threshold:
            return None
        again = numbered(kept.select("offset", "key", F.lit(PUT).alias("vtype"), "value"), ["offset"], "seq")
        rows = materialize(again.withColumn("seq", F.col("seq") + now["next_seq"] - 1), "moved")
        self._append(n, now, rows, dropped=(edge.oldest,))
        return edge.oldest

    def stats(self) -> DataFrame:
        """(metric, value): next number, end of the value log, index folders by level (1: put together), mutations and live keys."""
        rows = [*self.numbers().items(), ("entries", self.index().count()), ("live_keys", self.entries().count())]
        return self.spark.createDataFrame(rows, "metric string, value long")

    def numbers(self) -> dict[str, int]:
        """The statistics that the last commit has by itself."""
        now = self._now()[1]
        return {"sequence_number": now["next_seq"], "vlog_file_id": now["file_id"], "vlog_offset": now["offset"], "memtable_limit": self.options.memtable_size_limit, "index_folders": len(now["index"]), "value_folders": len(now["values"])}


class Writer:
    """Puts and deletes one by one: kept, the last one of each key, until they come to the memtable limit, and on ``close``.

    Look-ups through a writer see what it keeps before what the store has.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.used = store, 0
        self._kept: dict[str, tuple[int, str | None]] = {}

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close()

    def put(self, key: str, value: str) -> None:
        self._keep(key, (PUT, value))

    def delete(self, key: str) -> None:
        self._keep(key, (DELETE, None))

    def _keep(self, key: str, what: tuple[int, str | None]) -> None:
        if key not in self._kept:
            self.used += len(key.encode()) + folds.KEY_CHARGE
        self._kept[key] = what
        if self.used >= self.store.options.memtable_size_limit:
            self.flush()

    def get(self, key: str) -> str | None:
        return self._kept[key][1] if key in self._kept else self.store.get(key)

    def flush(self) -> int:
        """Writes what is kept as one batch; how many keys that was. A batch that is refused is kept."""
        if not self._kept:
            return 0
        batch = WriteBatch()
        batch.entries = [(vtype, key, value) for key, (vtype, value) in self._kept.items()]
        count = self.store.write(batch)
        self._kept, self.used = {}, 0
        return count

    def compact(self) -> None:
        self.flush()
        self.store.compact_range()

    def gc(self) -> int | None:
        self.flush()
        return self.store.run_gc()

    def close(self) -> None:
        self.flush()

    def stats_text(self) -> str:
        """The statistics as lines, those of the memtable first."""
        own = {"memtable_count": len(self._kept), "memtable_bytes": self.used, "immutable_memtables": 0}
        return "\n".join(f"{name}: {value}" for name, value in {**own, **self.store.numbers()}.items())
