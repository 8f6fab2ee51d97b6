import os
import socket
import threading
from dataclasses import replace

import pytest
from ledgerfen import server, shell
from ledgerfen.db import Options, Store, WriteBatch
from ledgerfen.session import scratch
from ledgerfen.sources.commits import Taken
from ledgerfen.streaming.commands import stream_into, stream_replies

from tables import rows

SMALL = Options(memtable_size_limit=2048, vlog_file_size_limit=4096, vlog_gc_threshold=0.3)


@pytest.fixture
def db(spark):
    return Store(spark, scratch(spark, "db"), SMALL)


def state(db):
    return {r.key: r.value for r in db.scan().collect()}


def test_operations(spark, db):
    assert db.get("key1") is None and db.scan().count() == 0 and db.run_gc() is None
    db.compact_range()
    db.put("key1", "value1")
    assert db.get("key1") == "value1"
    db.delete("key1")
    db.delete("never there")
    assert db.get("key1") is None
    batch = WriteBatch().put("k1", "v1").put("k2", "v2").delete("k1").put("k3", "").put("", "empty key")
    assert batch.count() == 5 and db.write(batch) == 5
    assert state(db) == {"": "empty key", "k2": "v2", "k3": ""}
    again = Store(spark, db.path, SMALL)
    assert state(again) == state(db)
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("zzz",)], "key string")
    assert rows(again.multi_get(wanted)) == [("k1", "NotFound: Key deleted", None), ("k2", "OK", "v2"), ("zzz", "NotFound: Key not found", None)]
    assert rows(again.scan(low="k2", high="k2")) == [("k2", "v2")] and [r.key for r in again.scan(prefix="k").collect()] == ["k2", "k3"]
    assert {r.metric: r.value for r in db.stats().collect()}["sequence_number"] == 9
    assert db.seek("k") == ("k2", "v2") and db.seek("k29", reverse=True) == ("k2", "v2") and db.seek("z") is None
    assert [r.key for r in db.scan(reverse=True).collect()] == ["k3", "k2", ""]
    with pytest.raises(Exception, match="a key is null"):
        db.write(spark.createDataFrame([(0, 1, None, "x")], "pos long, vtype int, key string, value string"))
    assert len(state(db)) == 3


def test_load_compact_delete_and_reclaim(spark, db):
    table = "pos long, vtype int, key string, value string"
    db.write(spark.createDataFrame([(i, 1, f"key_{i}", f"value_payload_data_for_key_{i}") for i in range(100)], table))
    db.write(spark.createDataFrame([(i, 2, f"key_{i}", None) for i in range(50)], table))
    expected = {f"key_{i}": f"value_payload_data_for_key_{i}" for i in range(50, 100)}
    db.compact_range()
    assert state(db) == expected and db.index().count() == 50
    runs = [(50 * run + i, 1, f"key_{50 + i}", f"new_payload_run_{run}_for_key_{50 + i}") for run in range(15) for i in range(50)]
    db.write(spark.createDataFrame(runs, table))
    expected = {f"key_{i}": f"new_payload_run_14_for_key_{i}" for i in range(50, 100)}
    assert state(db) == expected
    assert db.run_gc() == 1 and state(db) == expected
    assert db.values().where("file_id = 1").count() == 0
    folder = db.path.removeprefix("file://")
    segments = lambda: {x.removeprefix("file_id=") for w in os.listdir(f"{folder}/values") for x in os.listdir(f"{folder}/values/{w}") if x.startswith("file_id=")}
    assert "1" in segments() and db.expire() == []  # young folders stay
    db.compact_range()
    assert db.run_gc() == 2 and state(db) == expected
    gone = db.expire(grace_seconds=-5)
    assert not {"1", "2"} & segments() and any("index" in x for x in gone)
    assert state(db) == expected and db.get("key_50") == expected["key_50"] and db.get("key_1") is None
    assert {x for x in os.listdir(f"{folder}/index") if not x.startswith(".")} == {name for name, _ in db._now()[1]["index"]}


def test_folders_are_put_together_as_they_come(spark, db):
    due = lambda *sizes: db._due([["", n] for n in sizes])
    assert due() == due(5, 5, 5) == due(1000, 1, 1, 1) == 0
    assert due(1, 1, 1, 1) == 4 and due(1000, 1, 1, 1, 1) == 4 and due(30, 1, 1, 1, 1) == 5
    for i in range(6):
        db.write(WriteBatch().put("same", str(i)).put(f"k{i}", "v").delete(f"k{i - 1}"))
    assert len(db._now()[1]["index"]) < 4 and state(db) == {"same": "5", "k5": "v"}
    manual = Store(spark, scratch(spark, "db"), replace(SMALL, auto_maintain=False))
    for _ in range(5):
        manual.put("a", "b")
    assert len(manual._now()[1]["index"]) == 5 and manual.maintain() and not manual.maintain()
    # a tombstone stays while an older folder may have its key
    manual.write(spark.createDataFrame([(i, 1, f"x{i}", "v") for i in range(50)], "pos long, vtype int, key string, value string"))
    manual.compact_range()
    for key in ("a", "x1", "x2", "x3"):
        manual.delete(key)
    assert manual.maintain() and [n for _, n in manual._now()[1]["index"]] == [51, 4]
    assert manual.get("x1") is None and manual.get("x4") == "v"


def test_writer_keeps_until_the_limit_and_flushes_on_close(spark, db):
    with db.writer() as writer:
        writer.put("a", "1")
        writer.put("a", "2")
        writer.delete("b")
        assert writer.get("a") == "2" and writer.get("b") is None and db.get("a") is None
        assert writer.stats_text().split("\n")[:2] == ["memtable_count: 2", "memtable_bytes: 178"]
        for i in range(25):
            writer.put(f"key{i}", "v")
        assert db.get("a") == "2" and writer.used < 2048
    assert len(state(db)) == 26 and Store(spark, db.path, SMALL).get("key24") == "v"


def test_shell_on_a_store(spark, db):
    lines = ["put k v w", "get k", "get", "put", "delete", "", "compact", "delete k", "get k", "gc", "help", "put! a b", "nope x", "exit", "get k"]
    with db.writer() as writer:
        got = list(shell.answers(writer, lines))
        assert "sequence_number: 3" in next(shell.answers(writer, ["stats"])).split("\n")
    assert got == ["OK", "v", "Error: get requires key", "Error: put requires key and value", "Error: delete requires key", "OK", "OK", "(nil)", "OK", shell.HELP, "Unknown command: put!", "Unknown command: nope"]
    assert db.scan().count() == 0


def test_server_on_a_store(spark, db):
    with db.writer() as writer, server.serve(writer, port=0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        with socket.create_connection(running.server_address) as s:
            s.sendall("PING\r\nPUT a é\nGET a\nGET b\nDEL a\nGET a\nPUT\nGET\nwhat\nSTATS\n".encode())
            s.shutdown(socket.SHUT_WR)
            got = b"".join(iter(lambda: s.recv(4096), b"")).decode()
        running.shutdown()
    bad = "-ERR unknown command\r\n"
    assert got.startswith("+PONG\r\n+OK\r\n$2\r\né\r\n$-1\r\n+OK\r\n$-1\r\n+OK\r\n$0\r\n\r\n" + bad + "$") and "memtable_count: 2\n" in got
    assert state(db) == {"": ""}


def test_of_two_writers_one_is_refused(spark, db):
    db.put("a", "1")
    other = Store(spark, db.path, SMALL)
    seen = other._now()
    db.put("a", "2")
    other._now = lambda: seen
    with pytest.raises(Taken):
        other.put("a", "3")
    assert state(db) == {"a": "2"}


def test_lines_from_a_stream(spark, db, tmp_path):
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    expected = {0: ["+OK\r\n", "$1\r\n1\r\n", "$-1\r\n"], 1: ["$1\r\n1\r\n", "+OK\r\n", "$-1\r\n", "-ERR unknown command\r\n"]}
    for n, lines in enumerate((["PUT a 1", "GET a", "GET b"], ["GET a", "DEL a\r", "GET a", "what"])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(source)
        stream_replies(spark.readStream.text(source), db, "lines", out, check).awaitTermination()
        got = spark.read.parquet(f"{out}/batch={n}").orderBy("line_no").collect()
        assert [r.reply for r in got] == expected[n]
    assert state(db) == {}


def test_a_stream_is_taken_in_once(spark, db, tmp_path):
    source, check = (f"file://{tmp_path}/{x}" for x in ("in", "check"))
    schema = "pos long, vtype int, key string, value string"
    for n in range(3):
        spark.createDataFrame([(i, 1, f"k{i}", f"{n} {i}") for i in range(20)], schema).coalesce(1).write.mode("append").parquet(source)
        stream_into(spark.readStream.schema(schema).parquet(source), db, "s", check).awaitTermination()
    assert state(db) == {f"k{i}": f"2 {i}" for i in range(20)} and db._now()[1]["next_seq"] == 61
    again = spark.createDataFrame([(0, 1, "k0", "x")], schema)
    assert db.write(again, "s", 2) == 0 and db.get("k0") == "2 0"
