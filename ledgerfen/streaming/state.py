"""The current state of a mutation log that keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest, live


def stream_latest(mutations: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep each key's last mutation as streaming state and append what each micro-batch changed to the table ``out``.

    A mutation replaces the state only with a greater sequence number, whatever order they arrive in. Each micro-batch writes
    a folder of its own and overwrites it when it is run again after a failure, so nothing is lost or doubled. The query
    processes what is available and stops; started again, it goes on from ``checkpoint``.
    """
    last = mutations.where("seq IS NOT NULL").groupBy("key").agg(F.max(F.struct("seq", "vtype", "value")).alias("r"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.select("key", "r.*").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(key, seq, value) of the live keys of a table that ``stream_latest`` wrote."""
    rows = spark.read.schema("key string, seq long, vtype int, value string").parquet(f"{out}/batch=*")
    return live(latest(rows)).select("key", "seq", "value")
