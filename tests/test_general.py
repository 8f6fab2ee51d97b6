"""The general operators on small tables with nulls, ties, repeats, empty tables and clashing columns."""

import os
import random

import pytest
from ledgerfen.operators import changes, increments, orphans, small_files
from ledgerfen.session import scratch
from pyspark.sql import functions as F

from tables import MANIFEST, RUNS, SEGMENTS, SST, VLOG, WAL, at, delete, put, rows, with_extra


def frame(spark, data, schema):
    return with_extra(spark.createDataFrame(data, schema))


# small files


def _store(spark):
    sst, manifest = [], []
    for file_id, level, n in ((1, 0, 3), (2, 0, 2), (3, 0, 300), (4, 1, 2), (5, 2, 1), (6, 2, 1), (7, None, 1), (8, None, 1)):
        manifest.append((1, file_id, level, None, 999_999, "a", "z", at(0), None, at(1)))
        sst += [(1, level, file_id, p, f"k{p:04d}", 1, 10_000 * file_id + p, 1, p, 5) for p in range(n)]
    manifest.append((1, 6, 2, 1, 1, "a", "z", at(0), at(5), at(2)))  # the later listing removes it
    manifest.append((1, 9, 0, 0, 0, None, None, at(0), None, at(1)))  # without entries
    manifest.append((None, 1, 0, 0, 0, None, None, at(0), None, None))
    sst += [sst[0], (1, 0, 1, None, None, None, None, None, None, None), (None, 0, 1, 0, "x", 1, 1, 1, 1, 1)]
    return frame(spark, sst, SST), frame(spark, manifest, MANIFEST)


def test_small_files_are_found_by_true_size(spark):
    sst, manifest = _store(spark)
    found = small_files.find_small_files(manifest, sst)
    assert {(r.db_id, r.file_id) for r in found.collect()} == {(1, 1), (1, 2), (1, 9), (1, 7), (1, 8)}
    sizes = {r.sst_id: r.bytes for r in small_files.true_sizes(sst).collect()}
    assert sizes[2] == (1 + 5 + 25) * 2 + (1 + 5 + 8) + 4 + 8 + 48


def test_merging_keeps_every_entry_once(spark):
    sst, manifest = _store(spark)
    small = small_files.find_small_files(manifest, sst)
    plan = small_files.plan_merges(small, target_bytes=100).cache()
    new = small_files.rewrite(sst, plan)
    assert new.count() == 3 + 1 + 2 + 2
    assert plan.select("level", "lane", "bin").distinct().count() < plan.count()
    for _, group in new.toPandas().groupby(["level", "lane", "bin"], dropna=False):
        assert sorted(group.pos) == list(range(len(group)))


def _loaded(spark, path="store"):
    sst, manifest = _store(spark)
    store = small_files.SnapshotStore(spark, scratch(spark, path))
    small_files.load(store, sst.where("key IS NOT NULL"), manifest)
    return store


ROW = "db_id long, level int, sst_id long, pos long, key string, vtype int, seq long, file_id long, offset long, value_size long"


def _row(spark, key, level=0, sst_id=1, db=1):
    return spark.createDataFrame([(db, level, sst_id, 0, key, 1, 1, 1, 1, 1)], ROW)


def test_store_rewrites_only_the_partitions_concerned(spark):
    store = _loaded(spark)
    entries = store.read()
    assert entries.count() == 3 + 2 + 300 + 2 + 1 + 2  # file 6 is removed
    assert {(r.file_id, r.entries) for r in store.files().where("level = 0").collect()} == {(1, 3), (2, 2), (3, 300), (9, 0)}
    others = lambda v: rows(store.read(v).where("level > 0").select("level", "sst_id", "pos", "key"))
    replaced, version = small_files.compact(store)
    assert version == store.version() == 2 and others(2) == others(1)
    assert store.changed_since(1) == {"db_id=1/level=0", "db_id=1/level=__HIVE_DEFAULT_PARTITION__"}
    assert {(r.level, r.file_id) for r in replaced.collect()} == {(0, 1), (0, 2), (0, 9), (None, 7), (None, 8)}
    after = store.read()
    assert rows(after.select("level", *small_files.ENTRY)) == rows(entries.select("level", *small_files.ENTRY))
    files = {(r.level, r.file_id): r.entries for r in store.files().collect()}
    assert files == {(0, 3): 300, (0, 10): 5, (1, 4): 2, (2, 5): 1, (None, 11): 2} or files == {(0, 3): 300, (0, 11): 5, (1, 4): 2, (2, 5): 1, (None, 10): 2}
    # readers of the earlier version have it as it was, and types don't depend on the data
    assert store.read(1).count() == entries.count() and dict(store.read().dtypes)["db_id"] == "bigint"
    assert small_files.compact(store)[1] == 2  # nothing to do


def test_rows_that_only_the_store_has_survive(spark):
    store = _loaded(spark)
    store.commit(store.read(only={"db_id=1/level=0"}).unionByName(_row(spark, "only here", 0, 2)), store.version())
    small_files.compact(store)
    assert store.read().where("key = 'only here'").count() == 1


def test_interleaved_writers(spark):
    store = _loaded(spark)
    other, base = small_files.SnapshotStore(spark, store.path), store.version()
    real = store._commits.create

    def late(number, content):  # the other writer commits while this one is between its last look and its claim
        store._commits.create = real
        other.commit(_row(spark, "b", 3), base)
        return real(number, content)

    store._commits.create = late
    assert store.commit(_row(spark, "c", 5), base) == base + 2
    assert {"b", "c"} <= {r.key for r in store.read().collect()}

    def clash(number, content):
        store._commits.create = real
        other.commit(_row(spark, "d", 5), base + 2)
        return real(number, content)

    store._commits.create = clash
    with pytest.raises(small_files.ConflictError):
        store.commit(_row(spark, "e", 5), base + 2)
    assert {r.key for r in store.read().where("level = 5").collect()} == {"d"}
    assert store.reserve(3) + 3 == other.reserve(1)


def test_many_versions_and_expired_folders(spark):
    store = small_files.SnapshotStore(spark, scratch(spark, "store"))
    for i in range(18):
        store.commit(_row(spark, f"k{i}", i % 2), store.version())
    assert {r.key for r in store.read().collect()} == {"k16", "k17"} and {r.key for r in store.read(3).collect()} == {"k1", "k2"}
    assert store.expire(keep=1) == []  # all are young
    assert len(store.expire(keep=1, grace_seconds=-5)) == 16
    assert {r.key for r in store.read().collect()} == {"k16", "k17"}
    store.commit(_row(spark, "x", 0).limit(0), store.version(), touched={"db_id=1/level=0"})
    assert {r.key for r in store.read().collect()} == {"k17"}


def test_a_commit_appears_whole_or_not_at_all(spark, monkeypatch):
    from ledgerfen.sources.commits import Commits, Taken

    commits = Commits(spark, scratch(spark, "commits"))
    commits.create(1, {"a": 1})
    with pytest.raises(Taken):
        commits.create(1, {"a": 2})
    folder = commits.path.removeprefix("file://")
    assert commits.read(1) == {"a": 1} and [x for x in os.listdir(folder) if not x.endswith(".crc")] == ["000000000001"]
    # a folder without second names
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(PermissionError("no links")))
    commits.create(3, {"c": 3})
    with pytest.raises(Taken):
        commits.create(3, {"c": 4})
    assert commits.read(3) == {"c": 3}
    # the way of file systems other than the operating system's
    assert commits._rename(f"{commits.path}/.x", commits._file(2), "{}") and not commits._rename(f"{commits.path}/.y", commits._file(2), "[]")
    assert commits.read(2) == {} and commits.last() == 3


def test_small_files_of_empty_tables(spark):
    sst, manifest = frame(spark, [], SST), frame(spark, [], MANIFEST)
    small = small_files.find_small_files(manifest, sst)
    assert small.count() == 0 and small_files.plan_merges(small).count() == 0


# increments


def test_intervals(spark):
    schema = "feed string, db_id long, version int, block long, seq long"
    numbers = spark.createDataFrame([("f", 1, 0, 0, s) for s in (5, 1, 2, 2, 3, 7)] + [("f", None, 0, 0, 9)], schema)
    assert rows(increments.to_intervals(numbers).select("db_id", "lo", "hi")) == [(1, 1, 3), (1, 5, 5), (1, 7, 7), (None, 9, 9)]
    held = increments.with_contents(numbers.where("db_id = 1").distinct().withColumn("content", F.col("seq") * 10))
    assert rows(held.select("lo", "hi", "contents")) == [(1, 3, [10, 20, 30]), (5, 5, [50]), (7, 7, [70])]


def _contents(spark, data):
    return spark.createDataFrame([("wal", 1, s, k, 1, 1, 1, 1, at(t)) for s, k, t in data], "feed string, db_id long, seq long, key string, vtype int, file_id long, offset long, value_size long, seen_at timestamp")


def test_pending_takes_gaps_late_and_corrected_numbers(spark):
    wal = frame(
        spark,
        [put(1, 1, 1, 1, "a", t=1), put(1, 1, 1, 1, "a", t=1), put(1, 1, 2, 2, "b", t=2), put(1, 2, 1, 2, "b2", t=9), put(1, 2, 2, 5000, "c", t=3), put(1, 2, 3, 4, "d", t=11),
         put(1, 2, 4, 3, "torn", t=1, torn=True), put(1, 2, 5, None, "x", t=1), put(1, 2, 6, 6, "again", t=1), put(1, 2, 7, 6, "again", t=20), put(2, 1, 1, 1, "a", t=30), put(None, 1, 1, 1, "a", t=30)],
        WAL,
    )
    runs = frame(
        spark,
        [(1, "wal", at(0), at(5), at(6), " Succeeded ", at(7)), (2, "wal", at(0), at(50), None, "succeeded", at(51)), (3, "wal", at(0), at(60), at(61), "failed", at(62)),
         (4, "wal", at(0), at(90), at(91), "succeeded", at(92)), (4, "wal", at(0), at(90), at(91), "rolled_back", at(93)), (None, None, None, None, None, None, None)],
        RUNS,
    )
    found = increments.pending(increments.wal_contents(wal), runs)
    assert rows(found) == [("wal", 1, 2), ("wal", 1, 4), ("wal", 2, 1)]
    none = increments.pending(increments.wal_contents(wal), frame(spark, [], RUNS))
    assert {(r.db_id, r.seq) for r in none.collect()} == {(1, 1), (1, 2), (1, 5000), (1, 4), (1, 6), (2, 1)}
    assert increments.pending(increments.wal_contents(frame(spark, [], WAL)), runs).count() == 0


def test_sst_contents_need_a_listed_file(spark):
    sst = frame(spark, [(1, 0, 1, 0, "a", 1, 7, 1, 1, 1), (1, 0, 2, 0, "a", 1, 8, 1, 1, 1), (1, 0, 1, 1, "b", 2, None, 0, 0, 0)], SST)
    manifest = frame(spark, [(1, 1, 0, None, None, "a", "b", at(3), at(4), at(5)), (1, 3, 0, None, None, "a", "b", at(3), None, at(5))], MANIFEST)
    assert [(r.feed, r.seq, r.seen_at) for r in increments.sst_contents(sst, manifest).collect()] == [("sst", 7, at(3))]


def test_ledger_hands_over_each_content_once_and_survives_failures(spark):
    ledger = increments.IntervalLedger(spark, scratch(spark, "ledger"))
    first = [(1, "a", 1), (2, "b", 2), (9000, "c", 2)]
    assert {r.seq for r in ledger.run(_contents(spark, first)).collect()} == {1, 2, 9000}
    second = [*first, (2, "B", 5), (4, "d", 5), (4, "d", 6)]
    with pytest.raises(RuntimeError):
        ledger.run(_contents(spark, second), fail_before_commit=True)
    assert {r.seq for r in ledger.run(_contents(spark, second)).collect()} == {2, 4}
    assert ledger.run(_contents(spark, second)).count() == 0
    assert rows(ledger.intervals().select("version", "lo", "hi")) == [(0, 1, 2), (0, 4, 4), (0, 9000, 9000), (1, 2, 2)]


def test_a_late_content_is_handed_over_as_itself(spark):
    ledger = increments.IntervalLedger(spark, scratch(spark, "ledger"))
    assert rows(ledger.run(_contents(spark, [(1, "first", 5)])).select("key", "version")) == [("first", 0)]
    both = [(1, "first", 5), (1, "late", 2)]  # it appeared earlier, but comes in only now
    assert rows(ledger.run(_contents(spark, both)).select("key", "version")) == [("late", 1)]
    assert rows(ledger.run(_contents(spark, [*both, (1, "late", 1), (1, "third", 0)])).select("key", "version")) == [("third", 2)]


def test_only_blocks_that_changed_are_written(spark, monkeypatch):
    monkeypatch.setattr(increments, "MERGE_RUNS", 4)
    ledger = increments.IntervalLedger(spark, scratch(spark, "ledger"))
    data = [(s, "x", 1) for s in range(1, 9000, 100)]
    ledger.run(_contents(spark, data))
    ledger.run(_contents(spark, [*data, (5000, "y", 2)]))
    last = spark.read.parquet(f"{ledger.path}/{ledger._named()[-1]}/intervals")
    assert {r.block for r in last.collect()} == {1}
    assert ledger.intervals().selectExpr("sum(hi - lo + 1)").first()[0] == len(data) + 1
    for i in range(increments.MERGE_RUNS):
        ledger.run(_contents(spark, [*data, (5000, "y", 2), (1, f"z{i}", 2)]))
    assert len(ledger._named()) < 5
    assert ledger.run(_contents(spark, [*data, (5000, "y", 2), (1, "z0", 2)])).count() == 0


def test_ledger_against_brute_force(spark):
    rng = random.Random(3)
    history = [(rng.randrange(1, 60), rng.choice("ab"), t) for t in range(60)]
    ledger, seen = increments.IntervalLedger(spark, scratch(spark, "ledger")), set()
    for upto in (10, 35, 60):
        got = {r.seq for r in ledger.run(_contents(spark, history[:upto])).collect()}
        assert got == {s for s, k, _ in history[:upto] if (s, k) not in seen}
        seen |= {(s, k) for s, k, _ in history[:upto]}


# changes


def test_changes_column_by_column(spark):
    data = [
        ("a", 1, 1, "x", 1), ("a", 3, 3, None, 2), ("a", 2, 3, "y", None),  # patches, out of order
        ("b", 1, 1, "x", 1), ("b", 2, 2, None, None), ("b", 3, 3, "z", None),  # back after a delete, with one field
        ("c", 5, 1, None, 7), ("c", 4, 1, "old", 6),  # a replacement sets nulls too
        ("d", 1, 3, "p", None), ("e", 1, 2, None, None), ("f", 2, 1, "x", 1), ("f", 2, 2, None, None),
        (None, 1, 1, "n", 0), ("g", None, 1, "x", 1), ("h", 1, None, "x", 1), ("", 1, 1, "empty", 0), ("b", 3, 3, "z", None),
    ]
    df = frame(spark, data, "key string, seq long, kind int, v string, `w w` int")
    got = rows(changes.apply_changes(df, ["key"], "seq", "kind", ["v", "w w"]))
    assert got == sorted(
        [("", 1, "empty", 0), ("a", 3, "y", 2), ("b", 3, "z", None), ("c", 5, None, 7), ("d", 1, "p", None), (None, 1, "n", 0)], key=lambda r: tuple((x is None, str(type(x)), x) for x in r)
    )
    assert changes.apply_changes(df.limit(0), ["key"], "seq", "kind", ["v"]).count() == 0


def test_current_state_takes_the_last_correction(spark):
    wal = frame(
        spark,
        [put(1, 1, 1, 5, "a", (1, 0, 1)), put(1, 3, 1, 5, "b", (1, 9, 1)), put(1, 2, 9, 4, "a", (2, 2, 2)), put(1, 3, 2, 9, "x", torn=True), delete(1, 1, 2, 7, "c"), put(1, 1, 3, 6, "c"),
         put(1, 1, 4, 8, ""), put(1, 1, 4, 8, ""), put(2, 1, 1, 1, None), put(2, 1, 2, 1, "a")],
        WAL,
    )
    got = changes.current_state(wal).select("db_id", "key", "seq", "wal_id", "rec_no")
    assert rows(got) == [(1, "", 8, 1, 4), (1, "a", 4, 2, 9), (1, "b", 5, 3, 1), (2, "a", 1, 1, 2)]


# orphans


def test_orphans_as_of_the_reference(spark):
    vlog = frame(
        spark,
        [(1, 1, 0, 0, None, 1, "k", "abc", at(5)), (1, 1, 0, 0, 1, 1, "k", "abc", at(9)), (1, 1, 50, 0, 1, 1, "k", "", at(1)), (1, 2, 0, 0, 1, 1, "k", "é", at(1)), (1, 3, 0, 0, 1, 1, "k", None, at(1)), (None, 1, 0, 0, 1, 1, "k", "abc", at(1))],
        VLOG,
    )
    segments = frame(spark, [(1, 2, None, None, at(2), None), (1, 2, 1, 1, at(2), at(20)), (1, 2, 1, 1, at(2), at(30))], SEGMENTS)
    wal = frame(
        spark,
        [put(1, 1, 1, 1, "a", (1, 0, 3), 4), put(1, 1, 2, 2, "a", (1, 0, 3), 5), put(1, 1, 3, 3, "a", (1, 0, 2), 9), put(1, 1, 4, 4, "a", (1, 50, 0), 9), put(1, 1, 5, 5, "a", (2, 0, 2), 19),
         put(1, 1, 6, 6, "a", (2, 0, 2), 20), put(1, 1, 7, 7, "a", (None, 0, 2), 20), put(1, 1, 8, 8, "a", (3, 0, 0), 20), put(1, 1, 8, 8, "a", (3, 0, 0), 20), delete(1, 1, 9, 9, "a", 9), put(1, 1, 10, 10, "a", (9, 9, 9), None)],
        WAL,
    )
    stream = lambda w, v, g: orphans.deltas(orphans.wal_references(w), orphans.existence_deltas(v, g))
    found = orphans.orphans_as_of(stream(wal, vlog, segments))
    assert sorted({r.row_no for r in found.collect()}) == [1, 3, 6, 7, 8]
    assert orphans.orphans_as_of(stream(frame(spark, [], WAL), vlog, segments)).count() == 0
    nothing = frame(spark, [], VLOG), frame(spark, [], SEGMENTS)
    assert len({r.row_no for r in orphans.orphans_as_of(stream(wal, *nothing)).collect()}) == 8


def test_orphans_in_runs_against_brute_force(spark):
    rng = random.Random(9)
    wal = [put(1, 1, i, i, "a", (rng.randrange(1, 4), 0, 1) if rng.random() < 0.7 else (1, 0, 1), rng.randrange(60)) for i in range(300)]
    vlog = [(1, rng.randrange(1, 4), 0, 0, 1, 1, "k", "x", at(rng.randrange(60))) for _ in range(5)]
    segments = [(1, f, 1, 1, at(0), at(t)) for f, t in ((1, 45), (2, 30))]
    gone = {1: 45, 2: 30}
    born = [(f, t) for _, f, _, _, _, _, _, _, t in vlog]
    expected = {r[2] for r in wal if not any(f == r[8] and t <= r[11] and (f not in gone or at(gone[f]) > r[11]) for f, t in born)}
    stream = orphans.deltas(orphans.wal_references(frame(spark, wal, WAL)), orphans.existence_deltas(frame(spark, vlog, VLOG), frame(spark, segments, SEGMENTS))).cache()
    assert {r.row_no for r in orphans.orphans_as_of(stream).collect()} == expected
    ledger, found = orphans.CountLedger(spark, scratch(spark, "counts")), set()
    for lo, hi in ((None, 10), (10, 20), (20, 40), (40, 99)):
        part = stream.where(F.col("at") <= F.lit(at(hi)))
        part = part if lo is None else part.where(F.col("at") > F.lit(at(lo)))
        if hi == 20:
            with pytest.raises(RuntimeError):
                ledger.run(part, fail_before_commit=True)
        found |= {r.row_no for r in ledger.run(part).collect()}
    assert found == expected
    now = {r.file_id: r.refs for r in orphans.orphans(ledger.counts()).collect()}
    everyone = {f: sum(r[8] == f for r in wal) for f in (1, 2, 3)}
    assert now == {f: n for f, n in everyone.items() if f in gone or not any(b == f for b, _ in born)}


def test_counts_are_kept_from_run_to_run(spark):
    schema = "k string, d_ref int, d_exist int"
    day1 = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 1, 0), ("b", 0, 1), ("c", 0, 1), (None, 1, None)], schema)
    day2 = spark.createDataFrame([("a", 0, 1), ("b", 0, -1), ("c", 0, -1)], schema)
    counts = orphans.merge_counts(None, day1, ["k"])
    assert rows(orphans.orphans(counts).select("k", "refs")) == [("a", 2), (None, 1)]
    later = orphans.merge_counts(counts, day2, ["k"])
    assert rows(orphans.orphans(later).select("k", "refs")) == [("b", 1), (None, 1)]
    assert "c" not in {r.k for r in later.collect()}


# session


def test_scratch_is_cleaned(spark):
    from ledgerfen.session import clean, materialize

    kept = materialize(spark.range(3), "x")
    assert kept.count() == 3
    folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    clean(spark)
    assert not os.path.exists(folder)
