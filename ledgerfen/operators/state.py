"""The visible state of a mutation log: the mutation of the greatest sequence number of a key counts, unless it deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small
from .kvlog import DELETE, PUT
from .ordered import numbered, running

FIELDS = ["vtype", "value"]


def latest(mutations: DataFrame, keys: list[str] | None = None, fields: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, seq, fields) of each key's last mutation, deletes too.

    One aggregation with partial results, so a hot key is no hot task. Of equal sequence numbers the greater fields win.
    Rows of null sequence number are no mutations.
    """
    keys, fields = keys or ["key"], fields or FIELDS
    last = F.max(F.struct(seq, *fields)).alias("_last")
    out = mutations.where(F.col(seq).isNotNull()).groupBy(*keys).agg(last)
    return out.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in (seq, *fields)))


def live(state: DataFrame) -> DataFrame:
    """Tombstones are taken out after the choice of the last mutation, never before."""
    return state.where(F.col("vtype") == PUT)


def latest_state(mutations: DataFrame) -> DataFrame:
    return live(latest(mutations)).select("key", "seq", "value")


def snapshot(mutations: DataFrame, seq: int) -> DataFrame:
    """The state as it was after ``seq`` (an addition to the reference's operators)."""
    return latest_state(mutations.where(F.col("seq") <= seq))


def point_get(mutations: DataFrame, key: str) -> DataFrame:
    """One row (key, status, value): the filter on the key reaches the scan."""
    return _answers(mutations.sparkSession.createDataFrame([(key,)], "key string"), latest(mutations.where(F.col("key") == key)))


def multi_get(mutations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, status, value) of each distinct wanted key. Null keys aren't found."""
    wanted = wanted.select("key").distinct()
    small = if_small(wanted, wanted.count())
    return _answers(wanted, latest(mutations.join(small, "key", "left_semi")))


def status(vtype: Column) -> Column:
    return F.when(vtype == PUT, "OK").when(vtype == DELETE, "NotFound: Key deleted").otherwise("NotFound: Key not found")


def _answers(wanted: DataFrame, state: DataFrame) -> DataFrame:
    return wanted.join(state, "key", "left").select("key", status(F.col("vtype")).alias("status"), F.when(F.col("vtype") == PUT, F.col("value")).alias("value"))


def write_batch(batches: DataFrame) -> DataFrame:
    """(batch_id, key, seq, vtype, value): what remains of each batch, in which later mutations of a key replace earlier ones.

    ``batches`` has batch_id, batch_pos and the mutation; sequence numbers go up by one for each entry in that order.
    """
    rows = numbered(batches, ["batch_id", "batch_pos"], "seq")
    return latest(rows.withColumn("seq", F.col("seq").cast("long")), ["batch_id", "key"])


def scan(mutations: DataFrame, low: str | None = None, high: str | None = None, prefix: str | None = None, reverse: bool = False) -> DataFrame:
    """(pos, key, value) of the live keys in [low, high] and with ``prefix``, numbered from 1 in key order or against it.

    The bounds are applied to the keys before the aggregation and reach the scan. Keys are ordered by their bytes.
    """
    tests = [F.col("key") >= low if low is not None else None, F.col("key") <= high if high is not None else None, F.col("key").startswith(prefix) if prefix is not None else None]
    tests = [t for t in tests if t is not None]
    rows = mutations.where(reduce(lambda a, b: a & b, tests)) if tests else mutations
    order = F.desc("key") if reverse else F.asc("key")
    return numbered(latest_state(rows).select("key", "value"), [order], "pos").select(F.col("pos").cast("long").alias("pos"), "key", "value")


def seek(mutations: DataFrame, targets: list[str]) -> DataFrame:
    """(target, at, before): the first live key from ``target`` on and the last before it, for a few targets; null when there is none."""
    keys = latest_state(mutations).select("key")
    cols = [x for i, t in enumerate(targets) for x in (F.min(F.when(F.col("key") >= t, F.col("key"))).alias(f"at{i}"), F.max(F.when(F.col("key") < t, F.col("key"))).alias(f"before{i}"))]
    one = keys.agg(*cols)
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"at{i}").alias("at"), F.col(f"before{i}").alias("before")) for i, t in enumerate(targets)))).alias("r")
    return one.select(rows).select("r.*")


def tombstones(mutations: DataFrame) -> DataFrame:
    return latest(mutations).where(F.col("vtype") == DELETE).select("key", "seq")


def version_history(mutations: DataFrame) -> DataFrame:
    """(key, seq, vtype, version, next_seq, bytes): each mutation with its number from 1 and its successor (null: it is the last)."""
    rows = mutations.where("seq IS NOT NULL").select("key", "seq", "vtype", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("bytes"))
    rows = running(rows.withColumn("_one", F.lit(1)), ["key"], ["seq"], {"version": ("count", "_one")}, inclusive=True).drop("_one")
    rows = running(rows, ["key"], [F.desc("seq")], {"next_seq": ("last", "seq")})
    return rows.select("key", "seq", "vtype", F.col("version").cast("long").alias("version"), "next_seq", "bytes")
