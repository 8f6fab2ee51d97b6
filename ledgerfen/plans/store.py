"""Queries for the store's own operators over the test tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import changes, folds, logs, lsm, protocol, reclaim, state, stats
from ..operators.kvlog import POINTER, latest_listing
from ..session import load, materialize, scratch
from ..sources import logfiles, store
from ..streaming import state as stream_state
from ..workload import documents_log, events_log, lineitem_log

#: Sizes for the test data, whose stores are small.
SEGMENT, MEMTABLE = 4096, 2048
OLD_SEGMENT = 2048


# the state of a log


def kv_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(events_log(spark, sf_dir))


def kv_latest_state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(lineitem_log(spark, sf_dir))


def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.snapshot(events_log(spark, sf_dir), 3000)


def kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.point_get(events_log(spark, sf_dir), "user_7")


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey")).alias("key"))
    return state.multi_get(events_log(spark, sf_dir), wanted)


def kv_put_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_log(spark, sf_dir).select(F.floor(F.col("seq") / 100).alias("batch_id"), (F.col("seq") % 100).alias("batch_pos"), "key", "vtype", "value")
    return state.write_batch(rows)


def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.scan(lineitem_log(spark, sf_dir), low="order_2", high="order_5")


def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.scan(events_log(spark, sf_dir), prefix="user_1")


def kv_reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.scan(events_log(spark, sf_dir), reverse=True)


def kv_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.seek(events_log(spark, sf_dir), ["", "user_11", "user_5", "user_9999", "zzz"])


def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstones(lineitem_log(spark, sf_dir))


def kv_version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.version_history(events_log(spark, sf_dir))


# logs


def vlog_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.vlog_layout(events_log(spark, sf_dir), SEGMENT).drop("shard")


def vlog_layout_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values longer than a segment have one of their own."""
    return folds.vlog_layout(documents_log(spark, sf_dir), SEGMENT).drop("shard")


def vlog_deref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.deref(changes.current_state(load(spark, sf_dir, "wal")), load(spark, sf_dir, "vlog"))


def wal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.valid_prefix(load(spark, sf_dir, "wal")).select("db_id", "wal_id", "rec_no", "seq", "key", "vtype")


def wal_replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.replay(logs.valid_prefix(load(spark, sf_dir, "wal")))


def wal_next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal = load(spark, sf_dir, "wal")
    return logs.next_numbers(wal, logs.valid_prefix(wal))


def crc32c_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.checked(load(spark, sf_dir, "wal")).distinct()


def crc32c_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated and computed checksums of the value log's records."""
    return logs.checked_values(load(spark, sf_dir, "vlog")).distinct()


def wal_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records of one log format, written as log files and read back by recovery."""
    logfiles.register(spark)
    at = scratch(spark, "wal-files")
    one = logs.valid_prefix(load(spark, sf_dir, "wal")).where("vtype IN (1, 2)")
    # files of all databases in one folder: their numbers are made unique
    one = one.withColumn("wal_id", F.col("db_id") * 100_000 + F.col("wal_id"))
    one.repartition("wal_id").sortWithinPartitions("wal_id", "rec_no").write.format("kvwal").mode("append").save(at)
    return spark.read.format("kvwal").load(at).select(F.floor(F.col("wal_id") / 100_000).alias("db_id"), (F.col("wal_id") % 100_000).alias("wal_id"), "seq", "key", "vtype", *POINTER)


# runs, tables and look-ups


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.memtable_runs(events_log(spark, sf_dir), MEMTABLE)


def memtable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("seq", "key", "vtype", "run_id")


def memtable_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.memtable_usage(_runs(spark, sf_dir)).drop("shard")


def flush_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.flush(_runs(spark, sf_dir)).drop("shard")


def sst_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.listing(lsm.flush(_runs(spark, sf_dir)), ["run_id"])


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current listing, saved as text and loaded, without files that have no entries."""
    current = latest_listing(load(spark, sf_dir, "manifest")).where("removed_at IS NULL")
    at = scratch(spark, "manifest")
    store.save_manifest(current, at)
    return store.load_manifest(spark, at, load(spark, sf_dir, "sst").select("db_id", F.col("sst_id").alias("file_id"))).select("db_id", "file_id", "level", "num_entries", "smallest_key", "largest_key")


def sst_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = load(spark, sf_dir, "sst").select("db_id", "sst_id", "pos", "key").distinct()
    return store.unsorted(entries, ["db_id", "sst_id"])


def sst_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current entries, written as sorted files with key filters, and looked up by a range of keys."""
    at = scratch(spark, "sst")
    store.write_sorted(_current(spark, sf_dir, True), at, 8)
    return spark.read.parquet(at).where("key BETWEEN 'order_' AND 'user'").select("db_id", "sst_id", "pos", "key", "seq")


def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.sparse_index(load(spark, sf_dir, "sst"))


def sparse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sst = load(spark, sf_dir, "sst")
    probes = sst.select("db_id", "sst_id", F.concat("key", F.lit("!")).alias("key")).unionByName(sst.select("db_id", "sst_id", F.lit("").alias("key")))
    return lsm.sparse_lookup(lsm.sparse_index(sst), probes)


def _blooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.build_blooms(load(spark, sf_dir, "sst"), ["db_id", "sst_id"])


def bloom_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's keys, and as many that it hasn't, against its own filter: none is missed, and few others are taken for them."""
    own = load(spark, sf_dir, "sst").select("db_id", "sst_id", "key").distinct()
    probes = own.unionByName(own.withColumn("key", F.concat("key", F.lit("#")))).distinct()
    asked = lsm.may_contain(_blooms(spark, sf_dir), probes, ["db_id", "sst_id"])
    return asked.groupBy("db_id", "sst_id").agg(F.count(F.lit(1)).alias("probes"), F.count_if("maybe").alias("maybe"))


def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a file hasn't, made of those it has, against its filter: the share of false positives of each level."""
    sst = load(spark, sf_dir, "sst")
    probes = sst.select("db_id", "sst_id", F.concat("key", F.lit("#")).alias("key")).distinct().join(sst.select("db_id", "sst_id", "key").distinct(), ["db_id", "sst_id", "key"], "left_anti")
    asked = lsm.may_contain(_blooms(spark, sf_dir), probes, ["db_id", "sst_id"])
    return asked.groupBy("db_id").agg(F.count(F.lit(1)).alias("probes"), F.avg(F.col("maybe").cast("double")).alias("false_positive_rate"))


def _current(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    return lsm.current_entries(load(spark, sf_dir, "sst"), load(spark, sf_dir, "manifest"), distinct)


def layered_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.layered_get(_current(spark, sf_dir))


def memtable_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.memtable_get(_runs(spark, sf_dir)).drop("shard")


# compaction


def compact_overlap_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.overlap_inputs(load(spark, sf_dir, "manifest"), 1)


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.merge(_current(spark, sf_dir), lsm.overlap_inputs(load(spark, sf_dir, "manifest"), 0), 0)


def compact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir).where("NOT dropped").drop("dropped")


def compact_tombstone_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir).where("dropped").select("db_id", "key", "seq")


def compact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = lsm.overlap_inputs(load(spark, sf_dir, "manifest"), 0)
    return lsm.compact_level(_current(spark, sf_dir), inputs, 0, SEGMENT).select("db_id", "out_no", "key", "seq")


def compaction_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.policy(load(spark, sf_dir, "manifest"), load(spark, sf_dir, "sst"))


def state_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live state of the current files, which the compaction of level 0 doesn't change."""
    inputs = lsm.overlap_inputs(load(spark, sf_dir, "manifest"), 0)
    return lsm.after_compaction(_current(spark, sf_dir), inputs, 0).select("db_id", "key", "seq")


def state_after_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to log files through the layout of their values, recovered and looked up there: the latest state again."""
    logfiles.register(spark)
    base = scratch(spark, "recover")
    log = materialize(folds.vlog_layout(events_log(spark, sf_dir), SEGMENT, extra=("value",)), "layout")
    values = log.select("file_id", "offset", F.lit(1).alias("vtype"), "key", F.coalesce("value", F.lit("")).alias("value"))
    values.repartition("file_id").sortWithinPartitions("file_id", "offset").select("file_id", "vtype", "key", "value").write.format("kvvlog").mode("append").save(f"{base}/vlog")
    # a new log is begun with each memtable
    runs = folds.memtable_runs(events_log(spark, sf_dir), 4 * MEMTABLE).select("seq", "key", "vtype", F.col("run_id").alias("wal_id"))
    wal = runs.join(log.select("seq", *POINTER), "seq", "left").select("wal_id", "seq", "key", "vtype", *POINTER)
    wal.repartition("wal_id").sortWithinPartitions("wal_id", "seq").write.format("kvwal").mode("append").save(f"{base}/wal")
    again = spark.read.format("kvwal").load(f"{base}/wal")
    now = state.live(state.latest(again, ["key"], ["vtype", *POINTER]))
    there = spark.read.format("kvvlog").load(f"{base}/vlog").select("file_id", "offset", F.octet_length("value").cast("long").alias("value_size"), "value")
    return now.join(there, POINTER).select("key", "seq", "value")


def compact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels compacted one after the other: the entries and where they are in the end; no tombstone is left there."""
    return lsm.compact_range(_current(spark, sf_dir, True), SEGMENT).select("db_id", "level", "key", "seq", "vtype")


# reclaiming


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reclaim.records(load(spark, sf_dir, "vlog"), load(spark, sf_dir, "segments"))
    return reclaim.liveness(rows, changes.current_state(load(spark, sf_dir, "wal")))


def gc_segment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclaim.segment_ratio(_marked(spark, sf_dir))


def gc_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclaim.candidates(gc_segment_ratio(spark, sf_dir))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = materialize(_marked(spark, sf_dir), "marked")
    due = materialize(reclaim.candidates(reclaim.segment_ratio(marked)), "due")
    return reclaim.rewrite(marked, reclaim.safe(due, reclaim.damaged(load(spark, sf_dir, "vlog"), due)), OLD_SEGMENT)


def gc_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due segments of a value log in which some records of databases with an even number were changed after they were summed up.

    A segment that has such a record isn't reclaimed.
    """
    vlog = load(spark, sf_dir, "vlog")
    hit = (F.col("db_id") % 2 == 0) & (F.col("offset") % 3 == 0)
    broken = vlog.withColumn("value", F.when(hit, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    due = materialize(gc_candidate(spark, sf_dir), "due").where("due")
    bad = materialize(reclaim.damaged(broken, due), "damaged")
    kept = reclaim.safe(due, bad).select("db_id", "file_id", F.lit(True).alias("reclaimed"))
    return due.select("db_id", "file_id").join(bad, ["db_id", "file_id"], "left").join(kept, ["db_id", "file_id"], "left").select("db_id", "file_id", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("reclaimed", F.lit(False)).alias("reclaimed"))


def gc_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir)


def state_after_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclaim.state_after(changes.current_state(load(spark, sf_dir, "wal")), _moved(spark, sf_dir))


# statistics, protocols, codecs


def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.db_stats(load(spark, sf_dir, "wal"), load(spark, sf_dir, "vlog"), load(spark, sf_dir, "manifest"), load(spark, sf_dir, "sst"))


def _commands(spark: SparkSession, sf_dir: str, verbs: tuple[str, str, str, str]) -> DataFrame:
    put, get, delete, other = verbs
    kind = F.col("event_type")
    verb = F.when(kind == "purchase", put).when(kind == "error", delete).when(kind == "signup", other).otherwise(get)
    tail = F.when(kind == "purchase", F.concat(F.lit("  "), F.col("props"))).otherwise("")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.concat(verb, F.lit(" user_"), F.col("user_id").cast("string"), tail).alias("line"))


def protocol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.parse(_commands(spark, sf_dir, ("PUT", "GET", "DEL", "PING")))


def protocol_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.server_replies(_commands(spark, sf_dir, ("PUT", "GET", "DEL", "PING")))


def cli_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as commands, with statistics, compaction and reclaiming among them and changes without a key."""
    user = F.col("user_id")
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.when(user % 10 == 0, "stats").when(user % 10 == 1, "compact").when(user % 10 == 2, "gc").when(user % 50 == 3, "put").when(user % 50 == 13, "put! k v").alias("other"))
    lines = _commands(spark, sf_dir, ("put", "get", "delete", "what")).join(events, "line_no")
    return protocol.cli_replies(lines.select("line_no", F.coalesce("other", "line").alias("line")), "memtable_limit: 4194304")


def codec_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_orderkey") * F.col("l_partkey")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", codecs.varint_length(x).alias("bytes"), codecs.varint_hex(x).alias("digits"))


def codec_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = codecs.fixed_hex(F.col("o_orderkey") * 7, 4)
    return load(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits"), codecs.fixed_hex(F.col("o_custkey"), 8).alias("wide"), codecs.unfix_hex(digits, 4).alias("again"))


def crc32c_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "wal").where("key IS NOT NULL").select("key").distinct()
    return keys.select("key", codecs.crc32c_of("key").alias("crc"))


def codec_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers of the table files as bytes, and back; keys with their length before them."""
    digits = codecs.pointer_hex(F.col("file_id"), F.col("offset"), F.col("value_size"))
    rows = load(spark, sf_dir, "sst").select("key", *POINTER).distinct().withColumn("digits", digits)
    return rows.select("key", codecs.prefixed_hex(F.col("key")).alias("prefixed"), "digits", codecs.pointer_of(F.col("digits")).alias("p")).select("key", "prefixed", "digits", "p.*")


def codec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and numbers encoded and decoded again, also with the last byte cut off and with bytes that go on too long."""
    rows = load(spark, sf_dir, "sst").where("key IS NOT NULL AND seq IS NOT NULL").select("key", "seq").distinct()
    digits = F.concat(codecs.prefixed_hex(F.col("key")), codecs.varint_hex(F.col("seq"), 9))
    rows = rows.withColumn("digits", digits).withColumn("k", codecs.unprefixed_hex(F.col("digits")))
    number = lambda d, most=10: codecs.unvarint_hex(d, most)["value"]
    cut = codecs.unprefixed_hex(F.expr("left(digits, 2 * octet_length(key))"))
    overlong = number(F.concat(F.lit("80" * 4), codecs.varint_hex(F.col("seq"), 9)), 4)
    return rows.select("key", "seq", F.col("k.text").alias("text"), number(F.col("k.rest")).alias("number"), cut.isNull().alias("cut_fails"), overlong.isNull().alias("overlong_fails"))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of the log table are called, their size and records, from the scan's own metadata."""
    rows = load(spark, sf_dir, "wal").select("_metadata.file_name", "_metadata.file_size")
    return rows.groupBy("file_name", "file_size").agg(F.count(F.lit(1)).alias("records"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of value-log segments and the numbers read from them."""
    name = F.format_string("vlog_%05d.dat", F.col("file_id"))
    rows = load(spark, sf_dir, "segments").select("db_id", "file_id").distinct().withColumn("name", name)
    return rows.withColumn("number", F.regexp_extract("name", r"^vlog_(\d{5,})\.dat$", 1).cast("long"))


# streaming


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``kv_latest_state``, from a stream over the events' file."""
    at = scratch(spark, "stream")
    source = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(source).schema
    pattern = source if os.path.isdir(source) else f"{sf_dir}/events.parq*"
    rows = spark.readStream.schema(schema).parquet(pattern)
    vtype = F.when(F.col("event_type") == "error", 2).otherwise(1)
    log = rows.select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("user_"), F.col("user_id")).alias("key"), vtype.alias("vtype"), F.when(vtype == 1, F.col("props")).alias("value"))
    stream_state.stream_latest(log, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return stream_state.current(spark, f"{at}/table")


QUERIES = {
    f.__name__: f
    for f in (
        kv_latest_state, kv_latest_state_lines, kv_snapshot, kv_point_get, kv_multi_get, kv_put_delete_batch, kv_range_scan, kv_prefix_scan,
        kv_reverse_scan, kv_seek, kv_tombstones, kv_version_history, vlog_layout, vlog_layout_large, vlog_deref, wal_valid_prefix,
        wal_replay_state, wal_next_seq, crc32c_records, wal_file_round_trip, memtable_runs, memtable_usage, flush_l0, sst_manifest, manifest_round_trip,
        sst_sorted, sst_round_trip, sparse_index, sparse_lookup, bloom_semi, bloom_fpr, layered_get, memtable_get, compact_overlap_inputs, compact_merge,
        compact_tombstone_drop, compact_split, compaction_policy, compact_range, state_after_compaction, state_after_replay, gc_segment_ratio,
        gc_candidate, gc_refused, crc32c_values, codec_decode, gc_rewrite, state_after_gc, db_stats, protocol_parse, protocol_reply, cli_reply, codec_varint, codec_fixed,
        codec_pointer, crc32c_keys, file_names, file_sizes, stream_latest_state,
    )
}
