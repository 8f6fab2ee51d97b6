"""Streams into a store: mutations, and the server's line protocol over a stream of lines, such as a socket's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..db import Store
from ..operators.protocol import parse, server_replies


def stream_into(mutations: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of mutations (pos, vtype, key, value) to a store, a batch a commit, each once.

    ``pos`` is the order within a batch. How much a batch takes in is the source's setting (such as maxBytesPerTrigger). The
    store puts its folders together and reclaims a segment as the batches go. A batch that is run again after a failure is
    known by ``name`` and its number.
    """

    def write(batch: DataFrame, n: int) -> None:
        if not store.done(name, n):
            store.write(batch, name, n)
            store.run_gc()

    writer = mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_replies(lines: DataFrame, store: Store, name: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answer a streaming table of lines (column value) batch by batch on a store.

    ``out/batch=<n>`` gets (line_no, reply); puts and deletes go to the store. A batch sees the changes of the batches before
    it, of which only the keys that it asks for are read, and its own in the order of its lines. The replies are written
    before the changes are committed, so a batch that is run again after a failure either is done or finds the store as it was.
    """

    def answer(batch: DataFrame, n: int) -> None:
        if store.done(name, n):
            return
        batch = batch.select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line")).persist()
        try:
            parsed = parse(batch)
            held = store.multi_get(parsed.where("verb = 'GET'").select("key")).where("status = 'OK'")
            # what the asked keys hold is put again before the batch's own lines
            put = held.select(F.lit(-1).cast("long").alias("line_no"), F.concat_ws(" ", F.lit("PUT"), "key", "value").alias("line"))
            replies = server_replies(put.unionByName(batch), "\n".join(f"{k}: {v}" for k, v in store.numbers().items()))
            replies.where("line_no >= 0").write.mode("overwrite").parquet(f"{out}/batch={n}")
            changes = parsed.where("verb IN ('PUT', 'DEL')").select(F.col("line_no").alias("pos"), F.when(F.col("verb") == "PUT", 1).otherwise(2).alias("vtype"), "key", "value")
            store.write(changes, name, n)
        finally:
            batch.unpersist()

    writer = lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
