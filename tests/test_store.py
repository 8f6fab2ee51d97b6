"""The store's operators: the reference inputs, invariants, brute force on small logs, torn records, known values."""

import os
import random

import numpy as np
import pytest
from ledgerfen.functions import codecs
from ledgerfen.operators import folds, logs, lsm, ordered, protocol, reclaim, state
from ledgerfen.operators.kvlog import readable
from ledgerfen.session import scratch
from ledgerfen.sources import logfiles, store
from pyspark.sql import functions as F

from tables import MANIFEST, SEGMENTS, SST, VLOG, WAL, at, delete, put, rows, with_extra

LOG = "seq long, key string, vtype int, value string"


def log(spark, data):
    return with_extra(spark.createDataFrame(data, LOG))


def brute(data):
    last = {}
    for seq, key, vtype, value in sorted((d for d in data if d[0] is not None), key=lambda d: (d[0], d[2], d[3] or "")):
        last[key] = (seq, vtype, value)
    return last


def random_log(n=400, keys=23, seed=1):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        key = "hot" if rng.random() < 0.4 else rng.choice(["", "é", *(f"key_{i}" for i in range(keys))])
        out.append((seq, key, 2, None) if rng.random() < 0.25 else (seq, key, 1, "v" * rng.randrange(0, 30)))
    rng.shuffle(out)
    return out


# the reference's inputs


def reference_log():
    load = [(i + 1, f"key_{i}", 1, f"value_payload_data_for_key_{i}") for i in range(100)]
    gone = [(101 + i, f"key_{i}", 2, None) for i in range(50)]
    again = [(151 + 50 * run + i, f"key_{50 + i}", 1, f"new_payload_run_{run}_for_key_{50 + i}") for run in range(15) for i in range(50)]
    return load + gone + again


def test_put_get_delete(spark):
    data = [(1, "key1", 1, "value1")]
    assert rows(state.point_get(log(spark, data), "key1")) == [("key1", "OK", "value1")]
    assert rows(state.point_get(log(spark, [*data, (2, "key1", 2, None)]), "key1")) == [("key1", "NotFound: Key deleted", None)]
    assert rows(state.point_get(log(spark, data), "other")) == [("other", "NotFound: Key not found", None)]


def test_batch(spark):
    batch = spark.createDataFrame([(1, 0, "k1", 1, "v1"), (1, 1, "k2", 1, "v2"), (1, 2, "k1", 2, None), (1, 3, "k3", 1, "v3")], "batch_id long, batch_pos long, key string, vtype int, value string")
    assert rows(state.write_batch(batch)) == [(1, "k1", 3, 2, None), (1, "k2", 2, 1, "v2"), (1, "k3", 4, 1, "v3")]


def test_recovery_from_files(spark):
    logfiles.register(spark)
    path = scratch(spark, "recovery")
    wal = spark.createDataFrame([(1, 1, "keyA", 1, 1, 0, 4), (1, 2, "keyB", 1, 1, 21, 4), (2, 3, "keyA", 2, None, None, None)], "wal_id long, seq long, key string, vtype int, file_id long, offset long, value_size long")
    wal.repartition("wal_id").sortWithinPartitions("wal_id", "seq").write.format("kvwal").mode("append").save(path)
    again = spark.read.format("kvwal").load(path)
    assert rows(state.live(state.latest(again, ["key"], ["vtype", "offset"])).select("key", "offset")) == [("keyB", 21)]


def test_flush_compact_delete_and_reclaim(spark):
    df = log(spark, reference_log())
    expected = [(f"key_{i}", f"new_payload_run_14_for_key_{i}") for i in range(50, 100)]
    assert rows(state.latest_state(df).select("key", "value")) == sorted(expected)
    runs = folds.memtable_runs(df, 2048)
    flushed = lsm.flush(runs)
    assert flushed.select("run_id").distinct().count() > 1
    again = state.live(state.latest(flushed, ["key"], ["vtype"])).select("key", "seq")
    assert rows(again) == rows(state.latest_state(df).select("key", "seq"))
    layout = folds.vlog_layout(df, 4096)
    marked = layout.join(state.latest_state(df).select("seq", F.lit(True).alias("live")), "seq", "left").select(F.lit(1).alias("db_id"), "file_id", "offset", "rec_size", "key", F.coalesce("live", F.lit(False)).alias("live"))
    ratios = reclaim.segment_ratio(marked)
    first = reclaim.candidates(ratios, 0.3).collect()
    assert [(r.file_id, r.due) for r in first] == [(1, True)]


# state


def test_state_against_brute_force(spark):
    data = [*random_log(), (None, "key_1", 1, "x")]
    df, last = log(spark, data), brute(data)
    assert {r.key: (r.seq, r.vtype, r.value) for r in state.latest(df).collect()} == last
    live = {k: v for k, (_, t, v) in last.items() if t == 1}
    assert {r.key: r.value for r in state.latest_state(df).collect()} == live
    assert [(r.pos, r.key) for r in state.scan(df, "key_1", "key_2").orderBy("pos").collect()] == list(enumerate(sorted(k for k in live if "key_1" <= k <= "key_2"), 1))
    backward = sorted(live, key=str.encode, reverse=True)
    assert [r.key for r in state.scan(df, reverse=True).orderBy("pos").collect()] == backward
    assert {r.key for r in state.tombstones(df).collect()} == {k for k, (_, t, _) in last.items() if t == 2}
    assert state.latest_state(df.limit(0)).count() == 0 and state.scan(df.limit(0)).count() == 0


def test_gets_answer_each_wanted_key_once(spark):
    df = log(spark, [(1, "a", 1, ""), (2, "b", 1, "x"), (3, "b", 2, None)])
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "key string")
    assert rows(state.multi_get(df, wanted)) == [("a", "OK", ""), ("b", "NotFound: Key deleted", None), ("c", "NotFound: Key not found", None), (None, "NotFound: Key not found", None)]


def test_seek_and_history(spark):
    df = log(spark, [(1, "a", 1, "x"), (5, "a", 2, None), (2, "b", 1, "yy"), (9, "b", 1, None)])
    assert rows(state.seek(df, ["", "b", "c"])) == [("", "b", None), ("b", "b", None), ("c", None, "b")]
    assert rows(state.version_history(df).select("key", "seq", "version", "next_seq", "bytes")) == [("a", 1, 1, 5, 1), ("a", 5, 2, None, 0), ("b", 2, 1, 9, 2), ("b", 9, 2, None, 0)]


# running values


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_values_over_a_hot_group(spark, inclusive):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else rng.choice([None, "a", "b"]), i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(300)]
    df = with_extra(spark.createDataFrame(data, "g string, i long, x long"))
    values = {"s": ("sum", "x"), "m": ("max", "x"), "c": ("count", "x"), "l": ("last", "x"), "f": ("first", "x")}
    got = {r.i: (r.s, r.m, r.c, r.l, r.f) for r in ordered.running(df, ["g"], ["i"], values, inclusive, parts=7).collect()}
    for g, i, _ in data:
        before = [x for h, j, x in data if h == g and (j < i or inclusive and j == i) and x is not None]
        expected = (sum(before), max(before), len(before), before[-1], before[0]) if before else (None, None, 0, None, None)
        assert got[i] == expected


def test_numbers(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    assert rows(ordered.numbered(df, ["v"], "no").select("v", "no")) == [(i, i + 1) for i in range(100)]
    assert ordered.numbered(df.limit(0), ["v"]).count() == 0


# folds


def slow_rotation(sizes, limit, file_id=1, offset=0):
    out = []
    for s in sizes:
        if offset + s > limit and offset > 0:
            file_id, offset = file_id + 1, 0
        out.append((file_id, offset))
        offset += s
    return out


def test_rotation_by_batches(spark):
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.choice([0, 1, 5, 20, 200]) for _ in range(rng.randrange(1, 40))]
        segments, got, i = folds._Segments(1, 0, 50), [], 0
        while i < len(sizes):
            n = rng.randrange(1, 8)
            files, offsets = segments.place(np.array(sizes[i : i + n], np.int64))
            got += list(zip(files.tolist(), offsets.tolist()))
            i += n
        assert got == slow_rotation(sizes, 50)


def test_blocks_of_the_rotation_fit_together():
    rng = random.Random(8)
    for _ in range(500):
        limit = rng.choice([1, 20, 50])
        sizes = [rng.choice([1, 2, 7, 19, 30, 90]) for _ in range(rng.randrange(1, 60))]
        state = file_id, offset = 1, rng.choice([0, 0, 5, 49, 200])
        whole, i = slow_rotation(sizes, limit, file_id, offset), 0
        while i < len(sizes):
            block = np.array(sizes[i : i + rng.randrange(1, 25)], np.int64)
            files, offsets = folds._Segments(*state, limit).place(block)
            assert list(zip(files.tolist(), offsets.tolist())) == whole[i : i + len(block)]
            state = folds.after_block(*state, limit, int(block[0]), int(block.sum()), folds.summarize(block, limit))
            i += len(block)
            assert state == (whole[i - 1][0], whole[i - 1][1] + sizes[i - 1])


def test_layout_and_shards(spark):
    data = random_log()
    puts = sorted(d for d in data if d[2] == 1)
    sizes = [len(k.encode()) + len(v.encode()) + 13 for _, k, _, v in puts]
    got = [(r.file_id, r.offset) for r in folds.vlog_layout(log(spark, data), 100).orderBy("seq").collect()]
    assert got == slow_rotation(sizes, 100)
    blocks = folds.vlog_layout(log(spark, data), 100, block_rows=40)
    assert [(r.file_id, r.offset) for r in blocks.orderBy("seq").collect()] == got
    plain, split = (folds.vlog_layout(log(spark, data), 60, shards=3, block_rows=n).orderBy("seq").collect() for n in (10**6, 50))
    assert plain == split
    sharded = folds.vlog_layout(log(spark, data), 100, shards=3)
    assert sharded.count() == len(puts) and sharded.groupBy("key").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert folds.vlog_layout(log(spark, []), 100).count() == 0


def test_memtables_against_brute_force(spark):
    data = random_log()
    run, used, keys, expected = 1, 0, set(), {}
    for seq, key, _, _ in sorted(data):
        if key not in keys:
            keys.add(key)
            used += len(key.encode()) + 88
        expected[seq] = run
        if used >= 500:
            run, used, keys = run + 1, 0, set()
    assert {r.seq: r.run_id for r in folds.memtable_runs(log(spark, data), 500).collect()} == expected


def test_outputs_are_closed_by_the_entry_that_fills_them(spark):
    df = spark.createDataFrame([(d, i, s) for d in (1, 2) for i, s in enumerate([30, 30, 50, 10, 200, 5])], "db long, i long, size long")
    got = rows(folds.split_outputs(df, "db", ["i"], "size", 100).where("db = 2").select("i", "out_no"))
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]


# levels


def _levels(spark):
    sst = [
        (1, 0, 1, 0, "a", 1, 10, 1, 0, 1), (1, 0, 1, 1, "c", 2, 11, 0, 0, 0), (1, 0, 1, 2, "d", 2, 12, 0, 0, 0), (1, 0, 1, 2, "d", 2, 12, 0, 0, 0),
        (1, 0, 2, 0, "a", 1, 20, 1, 9, 1), (1, 1, 3, 0, "b", 1, 3, 1, 0, 1), (1, 1, 4, 0, "x", 1, 4, 1, 0, 1), (1, 2, 5, 0, "d", 2, 1, 0, 0, 0), (1, 0, 6, 0, "zz", 1, 99, 1, 0, 1),
    ]
    span = {1: ("a", "d"), 2: ("a", "a"), 3: ("b", "b"), 4: ("x", "x"), 5: ("d", "d")}
    manifest = [(1, f, lv, 1, 1, *span[f], at(0), None, at(1)) for f, lv in ((1, 0), (2, 0), (3, 1), (4, 1), (5, 2))] + [(1, 6, 0, 1, 1, "zz", "zz", at(0), at(1), at(2))]
    return with_extra(spark.createDataFrame(sst, SST)), with_extra(spark.createDataFrame(manifest, MANIFEST))


def test_compaction(spark):
    sst, manifest = _levels(spark)
    entries, inputs = lsm.current_entries(sst, manifest), lsm.overlap_inputs(manifest, 0)
    assert {r.file_id for r in inputs.collect()} == {1, 2, 3}
    merged = {r.key: (r.seq, r.dropped) for r in lsm.merge(entries, inputs, 0).collect()}
    assert merged == {"a": (20, False), "b": (3, False), "c": (11, True), "d": (12, False)}  # a tombstone below keeps 'd'
    before = rows(state.live(state.latest(entries, ["db_id", "key"], ["vtype"])).select("key", "seq"))
    assert rows(lsm.after_compaction(entries, inputs, 0).select("key", "seq")) == before == [("a", 20), ("b", 3), ("x", 4)]
    first = {r.key: (r.level, r.sst_id) for r in lsm.layered_get(entries).collect()}
    assert first == {"a": (0, 2), "b": (1, 3), "c": (0, 1), "d": (0, 1), "x": (1, 4)}
    empty = lsm.current_entries(sst.limit(0), manifest.limit(0))
    assert lsm.merge(empty, lsm.overlap_inputs(manifest.limit(0), 0), 0).count() == 0


def test_policy_lists_every_level(spark):
    sst, manifest = _levels(spark)
    got = rows(lsm.policy(manifest, sst).select("level", "files", "due"))
    assert got[:3] == [(0, 2, False), (1, 2, False), (2, 1, False)] and len(got) == lsm.LEVELS


def test_sparse_index_below_the_first_key(spark):
    sst = spark.createDataFrame([(1, 0, 1, p, f"k{p:02d}", 1, p, 1, 0, 0) for p in range(40)], SST)
    index = lsm.sparse_index(sst)
    assert rows(index.select("key", "data_offset", "block_end")) == [("k00", 0, 464), ("k16", 464, 928), ("k32", 928, 1160)]
    probes = spark.createDataFrame([(1, 1, k) for k in ("", "k15", "k16", "k16x", "z")] + [(1, 2, "a")], "db_id long, sst_id long, key string")
    assert rows(lsm.sparse_lookup(index, probes).select("key", "block")) == [("", 0), ("k15", 0), ("k16", 464), ("k16x", 464), ("z", 928)]


def test_filters_miss_no_key_and_are_exact(spark):
    keys = [f"key-{i}" for i in range(500)]
    df = spark.createDataFrame([(1, k) for k in keys] + [(2, ""), (2, None)], "f long, key string")
    blooms = lsm.build_blooms(df, ["f"])
    assert lsm.may_contain(blooms, df.where("key IS NOT NULL"), ["f"]).where("NOT maybe").count() == 0
    other = spark.createDataFrame([(1, f"other-{i}") for i in range(3000)], "f long, key string")
    assert lsm.may_contain(blooms, other, ["f"]).where("maybe").count() < 90
    bits = {r.f: bytes(r.bits) for r in lsm.bloom_bytes(blooms, ["f"]).collect()}
    assert len(bits[1]) == 625 and len(bits[2]) == 8
    expected = bytearray(8)
    h1, h2 = (int(codecs.murmur3([b""], s)[0]) for s in codecs.BLOOM_SEEDS)
    for i in range(6):
        p = (h1 + i * h2) % 64
        expected[p >> 3] |= 1 << (p & 7)
    assert bits[2] == bytes(expected)


# logs and files


def test_valid_prefix_and_replay(spark):
    wal = with_extra(spark.createDataFrame(
        [put(1, 1, 1, 1, "a"), put(1, 1, 2, 2, "b", torn=True), put(1, 1, 3, 3, "a", (9, 9, 9)), put(1, 2, 1, 9, "c"), put(1, 2, 2, 4, "c", (5, 5, 5)), put(1, 2, 2, 4, "c", (5, 5, 5)), delete(1, 2, 3, 5, "a"), put(2, 1, 1, 1, "x", torn=True), put(None, 1, 1, 1, "x")],
        WAL,
    ))
    good = logs.valid_prefix(wal)
    assert rows(good.select("wal_id", "rec_no")) == [(1, 1), (2, 1), (2, 2), (2, 3)]
    assert rows(logs.replay(good).select("key", "seq", "file_id")) == [("c", 4, 5)]  # the log's order counts
    assert rows(logs.next_numbers(wal, good)) == [(1, 10, 3), (2, 1, 2)]
    assert logs.valid_prefix(wal.limit(0)).count() == 0


def test_readable_is_never_null(spark):
    wal = spark.createDataFrame([put(1, 1, 1, 1, None), put(1, 1, 1, None, "a"), (1, 1, 1, 0, None, None, 1, "a", 1, 1, 1, at(0)), delete(1, 1, 1, 1, ""), put(1, 1, 1, 1, "é")], WAL)
    assert [r.r for r in wal.select(readable().alias("r")).collect()] == [False, False, False, True, True]


def test_records_of_log_files():
    a, b = logfiles.wal_record(1, 7, "é".encode(), (1, 2, 3)), logfiles.wal_record(2, 8, b"", None)
    assert len(a) == 37 + 2 and len(b) == 21
    assert list(logfiles.read_wal(a + b)) == [(1, 7, "é".encode(), (1, 2, 3)), (2, 8, b"", (None, None, None))]
    for cut in range(len(b)):
        assert len(list(logfiles.read_wal(a + b[:cut]))) == 1
    for i in range(len(a)):
        bad = bytearray(a + b)
        bad[i] ^= 1
        assert list(logfiles.read_wal(bytes(bad))) == []
    v = logfiles.vlog_record(1, b"k", b"")
    assert len(v) == 14 and [x[:2] for x in logfiles.read_vlog(v + v + v[:5])] == [(0, 14), (14, 14)]


def test_torn_file_on_disk(spark, tmp_path):
    logfiles.register(spark)
    good = logfiles.vlog_record(1, b"k", b"value") + logfiles.vlog_record(1, b"", b"")
    (tmp_path / "vlog_00001.dat").write_bytes(good + b"\0" * 7)
    (tmp_path / "vlog_123456.dat").write_bytes(logfiles.vlog_record(1, b"z", b"1"))
    (tmp_path / "notes.txt").write_bytes(b"x")
    got = rows(spark.read.format("kvvlog").load(str(tmp_path)).select("file_id", "offset", "key", "value"))
    assert got == [(1, 0, "k", "value"), (1, 19, "", ""), (123456, 0, "z", "1")]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("kvwal").load(str(empty)).count() == 0


def test_log_files_keep_bytes_and_refuse_to_overwrite(spark, tmp_path):
    logfiles.register(spark)
    path = str(tmp_path / "logs")
    one = spark.createDataFrame([(1, 1, bytearray(b"\xff"), 1, 1, 0, 1), (1, 2, bytearray(b"\xfe"), 2, None, None, None)], "wal_id long, seq long, key binary, vtype int, file_id long, offset long, value_size long")
    write = lambda df, mode: df.sortWithinPartitions("wal_id", "seq").write.format("kvwal").mode(mode).save(path)
    write(one.repartition("wal_id"), "append")
    keys = lambda: sorted(bytes(r.key) for r in spark.read.format("kvwal").option("bytes", "true").load(path).collect())
    assert keys() == [b"\xfe", b"\xff"]
    with pytest.raises(Exception, match="no text"):
        spark.read.format("kvwal").load(path).collect()
    with pytest.raises(Exception, match="wal_00001.log"):
        write(one.repartition("wal_id").where("seq = 1"), "append")
    with pytest.raises(Exception, match="several tasks"):
        write(one.withColumn("wal_id", F.lit(7).cast("long")).repartition(2, "seq"), "append")
    assert keys() == [b"\xfe", b"\xff"] and sorted(x.name for x in tmp_path.glob("logs/*")) == ["wal_00001.log"]
    write(one.repartition("wal_id").where("seq = 1"), "overwrite")
    assert keys() == [b"\xff"]
    for path in ("hdfs://host/logs", "s3a://bucket/logs"):
        with pytest.raises(Exception, match="operating system"):
            write(one, "append")
    assert not os.path.exists("hdfs:")


def test_deref(spark):
    vlog = spark.createDataFrame([(1, 1, 0, 0, None, 1, "k", "abc", at(1)), (1, 1, 0, 0, None, 1, "k", "abc", at(1))], VLOG)
    pointers = spark.createDataFrame([(1, "a", 1, 0, 3), (1, "b", 1, 0, 2), (1, "c", 1, 9, 3), (1, "d", None, None, None), (1, "e", 2, 0, 3), (1, "f", 2, 50, 1)], "db_id long, key string, file_id long, offset long, value_size long")
    right = int(codecs.crc32c([logfiles.vlog_record(1, b"k", b"abc")[4:]])[0])
    vlog = vlog.union(spark.createDataFrame([(1, 2, 0, 0, right, 1, "k", "abc", at(1)), (1, 2, 50, 0, right, 1, "k", "x", at(1))], VLOG))
    assert rows(logs.deref(pointers, vlog)) == [
        (1, "a", "OK", "abc"), (1, "b", "Corruption: Value size", None), (1, "c", "NotFound: No record", None), (1, "d", "NotFound: No record", None), (1, "e", "OK", "abc"), (1, "f", "Corruption: Checksum", None),
    ]
    assert rows(logs.checked_values(vlog).select("file_id", "offset", "ok").distinct()) == [(1, 0, None), (2, 0, True), (2, 50, False)]
    due = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.9, True)], "db_id long, file_id long, ratio double, due boolean")
    broken = reclaim.damaged(vlog, due)
    assert rows(broken) == [(1, 2, 1)] and rows(reclaim.safe(due, broken).select("file_id")) == [(1,)]


def test_listing_survives_any_key(spark):
    keys = ["", "a b", "tab\there", "back\\slash", "\\t", "line\nend", "é"]
    data = [(1, i, 0, 1, 1, k, k, at(0), None, at(1)) for i, k in enumerate(keys)]
    path = scratch(spark, "listing")
    store.save_manifest(spark.createDataFrame(data, MANIFEST), path)
    store.save_manifest(spark.createDataFrame(data, MANIFEST), path)
    there = spark.createDataFrame([(1, i) for i in range(6)], "db_id long, file_id long")
    assert [r.smallest_key for r in store.load_manifest(spark, path).orderBy("file_id").collect()] == keys
    assert store.load_manifest(spark, path, there).count() == 6


def test_unsorted_entries_are_counted(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (2, 0, "x")], "f long, pos long, key string")
    assert rows(store.unsorted(df, ["f"])) == [(1, 1), (2, 0)]


# reclaiming


def test_reclaiming_moves_live_records_only(spark):
    vlog = spark.createDataFrame([(1, f, o, 0, 0, 1, k, v, at(0)) for f, o, k, v in ((1, 0, "a", "x"), (1, 15, "b", "y"), (1, 30, "a", "z"), (2, 0, "c", "w"), (3, 0, "d", "q"))], VLOG)
    segments = spark.createDataFrame([(1, 3, None, None, None, at(1))], SEGMENTS)
    now = spark.createDataFrame([(1, "a", 1, 30, 1), (1, "b", 1, 15, 1), (1, "c", 2, 0, 1)], "db_id long, key string, file_id long, offset long, value_size long")
    marked = reclaim.liveness(reclaim.records(vlog, segments), now)
    assert rows(reclaim.segment_ratio(marked).select("file_id", "total_bytes", "live_bytes")) == [(1, 45, 30), (2, 15, 15)]
    due = reclaim.candidates(reclaim.segment_ratio(marked), 0.3)
    moved = reclaim.rewrite(marked, due, 32)
    assert rows(moved.select("key", "seq_step", "new_file_id", "new_offset")) == [("a", 2, 3, 0), ("b", 1, 2, 15)]
    moved_on = now.where("key != 'a'").union(spark.createDataFrame([(1, "a", 7, 7, 1)], now.schema))
    assert rows(reclaim.state_after(moved_on, moved).select("key", "file_id", "offset")) == [("a", 7, 7), ("b", 2, 15), ("c", 2, 0)]


# protocols and codecs


def test_server_replies(spark):
    lines = ["PING", "PUT a  é", "GET a", "GET b", "DEL a", "GET a", "PUT a", "GET a", "put a b", "", None, "STATS", "  GET\ta  ", "PUT", "GET"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    got = [r.reply for r in protocol.server_replies(df, "s: 1").orderBy("line_no").collect()]
    bad = "-ERR unknown command\r\n"
    assert got == ["+PONG\r\n", "+OK\r\n", "$2\r\né\r\n", "$-1\r\n", "+OK\r\n", "$-1\r\n", "+OK\r\n", "$0\r\n\r\n", bad, bad, bad, "$4\r\ns: 1\r\n", "$0\r\n\r\n", "+OK\r\n", "$0\r\n\r\n"]


def test_cli_replies(spark):
    lines = ["put k v w", "get k", "get", "put", "delete", "", "delete k", "get k", "compact", "gc", "stats", "help", "nope x", "put! k v", "exit", "get k"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    got = [r.reply for r in protocol.cli_replies(df, "S", "H").orderBy("line_no").collect()]
    assert got == ["OK", "v", "Error: get requires key", "Error: put requires key and value", "Error: delete requires key", "OK", "(nil)", "OK", "OK", "sequence_number: 3\nS", "H", "Unknown command: nope", "Unknown command: put!"]


def test_known_values():
    assert codecs.crc32c([b"123456789", b"", b"a"]).tolist()[:2] == [0xE3069283, 0]
    rng = random.Random(6)
    for size in (255, 256, 257, 700, 5000):  # pieces against a byte at a time
        value, crc = rng.randbytes(size), 0xFFFFFFFF
        for b in value:
            crc = int(codecs._TABLE[(crc ^ b) & 255]) ^ (crc >> 8)
        assert codecs.crc32c([b"x", value, b""]).tolist()[1] == crc ^ 0xFFFFFFFF
    assert codecs.murmur3([b"test", b"Hello, world!"], 0).tolist() == [0xBA6BD213, 0xC0363E43]


def test_decoders(spark):
    values = [0, 127, 128, 16383, 16384, 2**31, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("d", codecs.varint_hex(F.col("v"), 9))
    got = df.select("v", codecs.unvarint_hex(F.concat("d", F.lit("FF"))).alias("p"), codecs.unvarint_hex(F.expr("left(d, length(d) - 2)")).alias("cut")).collect()
    assert all(r.p.value == r.v for r in got) and all(r.cut is None for r in got)
    odd = spark.createDataFrame([("808080808001",), ("FF" * 10,), ("FFFFFFFFFFFFFFFFFF01",), ("",), (None,)], "d string")
    assert [r.p for r in odd.select(codecs.unvarint_hex(F.col("d"), 5).alias("p")).collect()] == [None] * 5
    assert [r.p and r.p.value for r in odd.select(codecs.unvarint_hex(F.col("d")).alias("p")).collect()] == [2**35, None, -1, None, None]
    texts = spark.createDataFrame([("",), ("é",), ("x" * 200,)], "k string").withColumn("d", codecs.prefixed_hex(F.col("k")))
    back = texts.select("k", codecs.unprefixed_hex(F.concat("d", F.lit("AB"))).alias("p"), codecs.unprefixed_hex(F.expr("left(d, length(d) - 2)")).alias("cut")).collect()
    assert all(tuple(r.p) == (r.k, "AB") and r.cut is None for r in back)


def test_codecs(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**31, 2**62, 2**63 - 1, -1, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r.n for r in df.select(codecs.varint_length(F.col("v")).alias("n")).collect()]
    assert got == [1, 1, 1, 2, 2, 3, 5, 9, 9, None, None]
    digits = [r.d for r in df.select(codecs.varint_hex(F.col("v")).alias("d")).collect()]
    assert digits[:7] == ["00", "01", "7F", "8001", "FF7F", "808001", "8080808008"] and digits[7:] == [None] * 4
    fixed = df.select(codecs.fixed_hex(F.col("v"), 4).alias("d"), codecs.unfix_hex(codecs.fixed_hex(F.col("v"), 4), 4).alias("back")).collect()
    assert fixed[5].d == "00400000" and fixed[5].back == 16384 and fixed[10].d is None
    nulls = spark.createDataFrame([(None,), ("",), ("é",)], "k string").select(codecs.crc32c_of("k").alias("c")).collect()
    assert nulls[0].c is None and nulls[1].c == 0 and nulls[2].c == int(codecs.crc32c(["é".encode()])[0])


# streaming


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from ledgerfen.streaming.state import current, stream_latest

    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    data, have = random_log(120), []
    for part in (data[:50], data[50:90], data[90:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        stream_latest(spark.readStream.schema(LOG).parquet(source), out, check).awaitTermination()
        have += part
        expected = {k: v for k, (_, t, v) in brute(have).items() if t == 1}
        assert {r.key: r.value for r in current(spark, out).collect()} == expected


# the entry point


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_queries_agree_with_their_sql(spark, sf_dir):
    pytest.importorskip("duckdb")
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
    import compare
    from ledgerfen import plans

    con = compare.connect(sf_dir)
    for name, sql in plans.ORACLE.items():
        df, cur = plans.QUERIES[name](spark, sf_dir), con.execute(sql)
        theirs, names = cur.fetchall(), [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names), name
        assert compare.bag(df.columns, df.collect()) == compare.bag(names, theirs), name


def test_compacting_all_levels_keeps_the_state(spark):
    rng, sst, seq = random.Random(11), [], 0
    for level, files in ((3, 1), (2, 2), (1, 2), (0, 3)):
        for f in range(files):
            keys = sorted(rng.sample([f"k{i:02d}" for i in range(30)], 8))
            for p, key in enumerate(keys):
                seq += 1
                sst.append((1, level, 100 * (4 - level) + f, p, key, rng.choice([1, 1, 2]), seq, 1, seq, 1))
    entries = spark.createDataFrame(sst, SST)
    before = rows(state.live(state.latest(entries, ["key"], ["vtype"])).select("key", "seq"))
    after = lsm.compact_range(entries, 100, levels=4)
    assert rows(state.live(state.latest(after, ["key"], ["vtype"])).select("key", "seq")) == before
    assert {r.level for r in after.select("level").distinct().collect()} == {3}
    assert after.groupBy("sst_id", "pos").count().where("count > 1").count() == 0
    assert lsm.compact_range(entries.limit(0), 100, levels=4).count() == 0


def test_pointers_prefixes_and_status(spark):
    df = spark.createDataFrame([(1, 2**40 + 5, 7, "é"), (None, None, None, None)], "f long, o long, s long, k string")
    digits = codecs.pointer_hex(F.col("f"), F.col("o"), F.col("s"))
    got = df.select(digits.alias("d"), codecs.pointer_of(digits).alias("p"), codecs.prefixed_hex(F.col("k")).alias("k")).collect()
    assert got[0].d == "01000000" + "0500000000010000" + "07000000" and tuple(got[0].p) == (1, 2**40 + 5, 7) and got[0].k == "02C3A9"
    assert got[1].d is None and got[1].k is None
    texts = spark.createDataFrame([("OK", "x"), ("NotFound", "gone"), ("IOError", None)], "c string, m string").select(codecs.status_text(F.col("c"), F.col("m")).alias("t"))
    assert [r.t for r in texts.collect()] == ["OK", "NotFound: gone", "IOError"]
