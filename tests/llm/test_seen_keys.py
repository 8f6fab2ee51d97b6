"""The ledger of keys: brute force, reopening, failures, and what it leaves behind."""

import random

import pytest
from ledgerfen.llm import seen_keys
from ledgerfen.session import scratch

from tables import WAL, put, with_extra

PLACE = ["db_id", "wal_id", "rec_no"]


def frame(spark, data):
    return with_extra(spark.createDataFrame(data, WAL))


def test_seen_keys_against_brute_force(spark):
    rng = random.Random(5)
    data, log = [], set()
    for db in (1, 2):
        for i in range(400):
            key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(150)}"
            data.append(put(db, rng.randrange(1, 9), i, i, key, torn=rng.random() < 0.1))
    data += data[:50] + [put(1, None, 1, 1, "x"), put(None, 1, 1, 1, "x"), put(1, 1, 9999, 1, ""), put(1, 2, 9999, 1, "")]
    for r in data:
        if r[0] and r[1] and r[4] == len(r[7].encode()) + 29:
            log.add((r[0], r[1], r[2], r[7]))
    first = {}
    for db, wal, rec, key in sorted(log):
        first.setdefault((db, key), (wal, rec))
    expected = {(db, wal, rec) for db, wal, rec, key in log if first[db, key] != (wal, rec)}
    wal = frame(spark, data)
    for batches in (1, 4):
        assert {tuple(r) for r in seen_keys.seen_before(wal, batches).collect()} == expected
    report = seen_keys.error_rate(wal, seen_keys.seen_before(wal, 2)).collect()
    assert all(r.wrong == 0 and r.rate == 0 for r in report) and sum(r.seen for r in report) == len(expected)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ledger_")]


def _open(spark, path, keys=("db_id", "key")):
    return seen_keys.KeyLedger(spark, path, list(keys), ["wal_id", "rec_no"])


def test_a_ledger_is_opened_again_by_its_path(spark):
    path = scratch(spark, "ledger")
    one = frame(spark, [put(1, 1, 1, 1, "a"), put(1, 1, 2, 2, "b"), put(1, 1, 3, 3, "a"), put(1, 1, 4, 4, None)])
    two = frame(spark, [put(1, 2, 1, 5, "b"), put(1, 2, 2, 6, "c"), put(2, 2, 1, 1, "a")])
    ledger = _open(spark, path)
    with pytest.raises(LookupError):
        ledger.table()
    assert [r.rec_no for r in ledger.seen(one, PLACE, ledger.append(one)).collect()] == [3]
    again = _open(spark, path)
    with pytest.raises(RuntimeError):
        again.append(two, "two", fail_before_commit=True)
    assert again.table().count() == 2
    third = _open(spark, path)
    batch = third.append(two, "two")
    assert [(r.wal_id, r.rec_no) for r in third.seen(two, PLACE, batch).collect()] == [(2, 1)]
    # the same batch once more: found by its token, with the same answers
    assert _open(spark, path).append(two, "two") == batch and len(third.batches()) == 2
    assert sorted((r.db_id, r.key) for r in ledger.table().collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
    third.merge()
    assert len(ledger.batches()) == 1 and ledger.table().count() == 4
    last = frame(spark, [put(1, 3, 1, 9, "c"), put(1, 3, 2, 9, "z")])
    assert [r.rec_no for r in ledger.seen(last, PLACE, ledger.append(last)).collect()] == [1]
    with pytest.raises(ValueError):
        _open(spark, path, ["key"])


def test_wrong_answers_are_counted(spark):
    wal = frame(spark, [put(1, 1, 1, 1, "a"), put(1, 1, 2, 2, "a"), put(1, 1, 3, 3, "b")])
    answers = spark.createDataFrame([(1, 1, 3)], "db_id long, wal_id long, rec_no long")
    assert [(r.records, r.seen, r.wrong) for r in seen_keys.error_rate(wal, answers).collect()] == [(3, 1, 2)]


def test_seen_keys_of_an_empty_log(spark):
    assert seen_keys.seen_before(frame(spark, []), 3).count() == 0


def test_the_ledger_is_not_shuffled(spark):
    path = scratch(spark, "ledger")
    for w in (1, 2):
        ledger = _open(spark, path)
        ledger.append(frame(spark, [put(1, w, r, r, f"k{w}{r}") for r in range(20)]))
    plan = ledger.table().groupBy("db_id", "key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
