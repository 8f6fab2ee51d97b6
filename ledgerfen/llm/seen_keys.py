"""Has this key been seen before? An exact ledger of keys in hash buckets on disk.

The ledger has one row for each key so far: the key and the place of its first record, in buckets by the key's hash, sorted. A
batch is first reduced to its distinct keys, each with its first record (rank 1 by arrival), with partial results before the
shuffle; these are sort-merge left-joined to the ledger bucket by bucket, and the new ones are appended as a folder of their
own. A record is then new exactly when it is the place of a key that its batch appended. Nothing is kept in memory and no
answer is wrong.

A ledger is its folder: it can be opened again by anyone who has the path. A batch counts once a commit names its folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kvlog import readable
from ..session import scratch
from ..sources.commits import Commits


class KeyLedger:
    """Keys ``keys`` with the place ``order`` of their first record, under ``path``.

    The number of ``buckets`` is that of the first batch ever, by default the session's number of shuffle partitions then: a
    batch's aggregation is partitioned like the ledger and the ledger is never shuffled. A record with a null in its key has
    no key: it is never seen before and not remembered. Places are compared in the order of ``order``. A ledger of other
    columns at the path is refused.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int | None = None) -> None:
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self._commits = Commits(spark, f"{self.path}/commits")
        now = self._now()
        if now and (now["keys"], now["order"]) != (keys, order):
            raise ValueError(f"{path} is a ledger of {now['keys']} by {now['order']}")
        self.buckets = now["buckets"] if now else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _now(self) -> dict:
        last = self._commits.last()
        return self._commits.read(last) if last else {}

    def batches(self) -> list[str]:
        """The folders that make up the ledger."""
        return self._now().get("batches", [])

    def table(self, batches: list[str] | None = None) -> DataFrame:
        """(keys, order) of the committed batches, or of ``batches``; bucketed by the keys.

        The catalog has the table only until its files are listed, so nothing is left behind there.
        """
        now = self._now()
        batches = now.get("batches", []) if batches is None else batches
        if not batches:
            raise LookupError("the ledger has no batch yet")
        name, keys = f"ledger_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in self.keys)
        setting = "spark.sql.hive.manageFilesourcePartitions"  # partitions are found in the folder, not in the catalog
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            self.spark.sql(
                f"CREATE TABLE {name} ({now['schema']}, batch STRING) USING parquet PARTITIONED BY (batch) "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
            )
            return self.spark.table(name).where(F.col("batch").isin(batches)).select(*self.keys, *self.order)
        finally:
            self.spark.conf.set(setting, before)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame, batch: str) -> None:
        name = f"ledger_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        try:
            writer.option("path", f"{self.path}/data/batch={batch}").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=self.keys)

    def _batch_of(self, token: str) -> str | None:
        """The folder of the batch that was committed under a token."""
        found = (self._commits.read(n) for n in range(self._commits.last(), 0, -1))
        return next((c["batch"] for c in found if c.get("token") == token), None)

    def append(self, batch: DataFrame, token: str | None = None, fail_before_commit: bool = False) -> str:
        """Take in the keys of a batch; the name of its folder. Batches must come in the order of arrival.

        A batch that failed can be appended again: what it has written is named by no commit. With a ``token`` that names the
        batch, one that was committed after all is found and not taken in twice. Of two writers at once one is refused.
        """
        if token is not None and (done := self._batch_of(token)):
            return done
        last, now = self._commits.last(), self._now()
        first = self._keyed(batch).groupBy(*self.keys).agg(F.min(F.struct(*self.order)).alias("_first"))
        first = first.select(*self.keys, *(F.col(f"_first.{c}").alias(c) for c in self.order))
        schema = now.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema)
        if now:
            old = self.table().select(*(F.col(k).alias(f"_old_{k}") for k in self.keys), F.lit(1).alias("_known"))
            same = None
            for k in self.keys:
                test = F.col(k) == F.col(f"_old_{k}")
                same = test if same is None else same & test
            first = first.hint("merge").join(old, same, "left").where("_known IS NULL").select(*self.keys, *self.order)
        name = f"{last + 1}-{uuid.uuid4().hex}"
        self._write(first, name)
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        content = {"keys": self.keys, "order": self.order, "buckets": self.buckets, "schema": schema, "batch": name, "token": token}
        self._commits.create(last + 1, content | {"batches": [*now.get("batches", []), name]})
        return name

    def merge(self) -> None:
        """Put all batches together in one folder, for ledgers of very many batches; the old folders stay for their readers."""
        last, now = self._commits.last(), self._now()
        if len(now.get("batches", [])) > 1:
            name = f"{last + 1}-{uuid.uuid4().hex}"
            self._write(self.table(), name)
            self._commits.create(last + 1, now | {"batches": [name], "batch": name, "token": None})

    def seen(self, records: DataFrame, identity: list[str], batch: str) -> DataFrame:
        """The ``identity`` of the records of a batch, each once, whose key occurred before them, in it or in an earlier one.

        Only the rows that the batch has appended are looked at. ``identity`` must hold ``order`` and tell records of
        different keys apart; the anti join is on it, so a hot key doesn't matter here either.
        """
        new = self.table([batch]).select(*identity)
        return self._keyed(records).select(*identity).distinct().join(new, identity, "left_anti")


def batches_of(wal: DataFrame, batches: int) -> list[DataFrame]:
    """The log in ``batches`` parts of about the same size, by ranges of wal_id; the ranges keep each database's log order.

    The limits are approximate quantiles over all rows; any limits would give the same answers.
    """
    cuts = wal.select(F.percentile_approx("wal_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    edges = [None, *cuts, None]
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        part = wal if lo is None else wal.where(F.col("wal_id") > lo)
        parts.append(part if hi is None else part.where(F.col("wal_id") <= hi))
    return parts


def log_records(wal: DataFrame) -> DataFrame:
    """(db_id, wal_id, rec_no, key) of the readable records that have a place in a log."""
    return wal.where(readable()).where("db_id IS NOT NULL AND wal_id IS NOT NULL AND rec_no IS NOT NULL").select("db_id", "wal_id", "rec_no", "key")


def seen_before(wal: DataFrame, batches: int = 3, path: str | None = None) -> DataFrame:
    """(db_id, wal_id, rec_no) of the records whose key stands earlier in the log of the database.

    The ledger is opened anew for each batch. Records repeated as a whole are one record. Torn records are neither asked nor
    remembered.
    """
    spark, path = wal.sparkSession, path or scratch(wal.sparkSession, "ledger")
    out = None
    for part in batches_of(log_records(wal), batches):
        ledger = KeyLedger(spark, path, ["db_id", "key"], ["wal_id", "rec_no"])
        found = ledger.seen(part, ["db_id", "wal_id", "rec_no"], ledger.append(part))
        out = found if out is None else out.unionByName(found)
    return out


def error_rate(wal: DataFrame, seen: DataFrame) -> DataFrame:
    """(db_id, records, seen, wrong, rate) of answers held against each key's first record, found in one pass without ledger."""
    place = ["db_id", "wal_id", "rec_no"]
    records = log_records(wal)
    first = records.groupBy("db_id", "key").agg(F.min(F.struct("wal_id", "rec_no")).alias("f")).select("db_id", "f.*")
    marks = (
        records.select(*place).distinct().select(*place, F.lit(1).alias("r"), F.lit(0).alias("f"), F.lit(0).alias("s"))
        .unionByName(first.select(*place, F.lit(0).alias("r"), F.lit(1).alias("f"), F.lit(0).alias("s")))
        .unionByName(seen.select(*place, F.lit(0).alias("r"), F.lit(0).alias("f"), F.lit(1).alias("s")))
    )
    each = marks.groupBy(*place).agg(F.max("r").alias("r"), F.max("f").alias("f"), F.max("s").alias("s"))
    wrong = F.sum((F.col("f") == F.col("s")).cast("long")).alias("wrong")
    total = each.groupBy("db_id").agg(F.sum("r").cast("long").alias("records"), F.sum("s").cast("long").alias("seen"), wrong)
    return total.withColumn("rate", F.col("wrong") / F.col("records"))
