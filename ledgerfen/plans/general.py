"""Queries p1 to p4 over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, increments, orphans, small_files
from ..session import load, materialize, scratch


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[small_files.SnapshotStore, DataFrame]:
    """A store of the current files after its compaction, and the files that this replaced."""
    store = small_files.SnapshotStore(spark, scratch(spark, "store"))
    small_files.load(store, load(spark, sf_dir, "sst"), load(spark, sf_dir, "manifest"))
    return store, small_files.compact(store)[0]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the compaction of the current files replaces."""
    return _compacted(spark, sf_dir)[1].select("db_id", "file_id")


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the merged files: those of the small files, each once."""
    sst = load(spark, sf_dir, "sst")
    plan = materialize(small_files.plan_merges(small_files.find_small_files(load(spark, sf_dir, "manifest"), sst)), "plan")
    return small_files.rewrite(sst, plan).select("db_id", "level", *small_files.ENTRY)


def p1_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the whole store after its compaction."""
    return _compacted(spark, sf_dir)[0].read().select("db_id", "level", *small_files.ENTRY)


def p1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and entries of each level before and after the compaction."""
    store, _ = _compacted(spark, sf_dir)
    count = lambda v, name: store.files(v).groupBy("db_id", "level").agg(F.count(F.lit(1)).alias(f"files_{name}"), F.sum("entries").cast("long").alias(f"entries_{name}"))
    then, now = count(1, "before"), count(None, "after")
    same = then["db_id"].eqNullSafe(now["db_id"]) & then["level"].eqNullSafe(now["level"])
    return then.join(now, same, "left").select(then["db_id"], then["level"], "files_before", "files_after", "entries_before", "entries_after")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal = increments.wal_contents(load(spark, sf_dir, "wal"))
    sst = increments.sst_contents(load(spark, sf_dir, "sst"), load(spark, sf_dir, "manifest"))
    return increments.pending(wal.unionByName(sst), load(spark, sf_dir, "run_log"))


def p2_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger hands over after the last two good runs of each feed were run on it; the first takes all before it, too."""
    wal = increments.wal_contents(load(spark, sf_dir, "wal"))
    contents = wal.unionByName(increments.sst_contents(load(spark, sf_dir, "sst"), load(spark, sf_dir, "manifest")))
    reads = increments.good_reads(load(spark, sf_dir, "run_log")).groupBy("feed").agg(F.slice(F.array_sort(F.collect_set("read_at"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), 1, 2).alias("last"))
    reads = materialize(reads.select(F.col("feed").alias("feed_"), "last"), "reads")
    timed = materialize(contents.join(F.broadcast(reads), F.col("feed") == F.col("feed_"), "left").drop("feed_"), "contents")
    ledger = increments.IntervalLedger(spark, scratch(spark, "intervals"))
    for back in (2, 1):
        ledger.run(timed.where(F.col("seen_at") <= F.try_element_at("last", F.lit(back))))
    return ledger.run(timed).select("feed", "db_id", "seq", *increments.CONTENT)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.current_state(load(spark, sf_dir, "wal")).select("db_id", "wal_id", "rec_no")


def p3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state itself: each live key with its sequence number and pointer."""
    return changes.current_state(load(spark, sf_dir, "wal")).select("db_id", "key", "seq", "file_id", "offset", "value_size")


def p3_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a feed of partial updates: a put of an odd number sets only what its kind of number sets.

    A put whose number is divisible by 5 replaces the row; others whose number is divisible by 2 set the offset, by 3 the size
    of the value, and the rest set the file. Deletes delete. So fields come from different changes.
    """
    own = changes.last_corrections(load(spark, sf_dir, "wal"))
    kind = F.when(F.col("vtype") == 2, 2).when(F.col("seq") % 5 == 0, 1).otherwise(3)
    only = lambda c, test: F.when((F.col("seq") % 5 == 0) | test, F.col(c)).alias(c)
    by2, by3 = F.col("seq") % 2 == 0, F.col("seq") % 3 == 0
    feed = own.select("db_id", "key", "seq", kind.alias("kind"), only("offset", by2), only("value_size", ~by2 & by3), only("file_id", ~by2 & ~by3))
    return changes.apply_changes(feed, ["db_id", "key"], "seq", "kind", ["file_id", "offset", "value_size"])


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sst = orphans.sst_references(load(spark, sf_dir, "sst"), load(spark, sf_dir, "manifest"))
    return orphans.wal_references(load(spark, sf_dir, "wal")).unionByName(sst)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.deltas(_references(spark, sf_dir), orphans.existence_deltas(load(spark, sf_dir, "vlog"), load(spark, sf_dir, "segments")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans_as_of(_stream(spark, sf_dir)).select("ref_table", "db_id", "holder_id", "row_no").distinct()


def p4_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, database and day of the referring record."""
    found = orphans.orphans_as_of(_stream(spark, sf_dir))
    each = found.groupBy("ref_table", "db_id", "holder_id", "row_no").agg(F.min("at").alias("at"))
    return each.groupBy("ref_table", "db_id", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("orphans"))


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orphans, found by three runs of a ledger of counts, each of which takes in a third of the time."""
    stream = materialize(_stream(spark, sf_dir), "deltas")
    ledger = orphans.CountLedger(spark, scratch(spark, "counts"))
    edge = stream.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if edge.lo is None:
        return ledger.run(stream).select("ref_table", "db_id", "holder_id", "row_no")
    cuts = [edge.lo + (edge.hi - edge.lo) * i / 3 for i in (1, 2)]
    at = F.col("at")
    parts = [stream.where(at <= cuts[0]), stream.where((at > cuts[0]) & (at <= cuts[1])), stream.where(at > cuts[1])]
    found = [ledger.run(p) for p in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("ref_table", "db_id", "holder_id", "row_no").distinct()


def p4_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers that are referred to but have no target now, with their counts."""
    existence = orphans.existence_deltas(load(spark, sf_dir, "vlog"), load(spark, sf_dir, "segments"))
    counts = orphans.merge_counts(None, orphans.deltas(_references(spark, sf_dir).distinct(), existence), orphans.KEY)
    return orphans.orphans(counts).select(*orphans.KEY, "refs")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_entries, p1_compact, p1_levels, p2_found, p2_replayed, p3_found, p3_state, p3_partial, p4_found, p4_by_day, p4_runs, p4_current)
}

_READABLE = "key IS NOT NULL AND seq IS NOT NULL AND len = octet_length(encode(key)) + CASE vtype WHEN 1 THEN 29 WHEN 2 THEN 13 END"
_LISTED = "listed AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY db_id, file_id ORDER BY listed_at DESC, removed_at DESC NULLS LAST) = 1)"
_SMALL = f"""
{_LISTED}, entry AS (SELECT DISTINCT *, octet_length(encode(key)) AS k FROM sst),
sized AS (
  SELECT db_id, sst_id, sum(k + 25 + CASE WHEN k >= 128 THEN 2 ELSE 1 END + CASE WHEN pos % 16 = 0 THEN k + 8 + CASE WHEN k >= 128 THEN 2 ELSE 1 END ELSE 0 END)
         + 4 + ceil(greatest(64, 10 * count(*)) / 8) + 48 AS bytes
  FROM entry GROUP BY ALL),
tiny AS (
  SELECT l.db_id, l.file_id, l.level, count(*) OVER (PARTITION BY l.db_id, l.level) AS n
  FROM listed l LEFT JOIN sized s ON l.db_id = s.db_id AND l.file_id = s.sst_id
  WHERE l.removed_at IS NULL AND coalesce(s.bytes, 60) < 4096)
"""
_REFS = f"""
{_LISTED},
refs AS (
  SELECT DISTINCT 'wal' AS ref_table, db_id, wal_id AS holder_id, rec_no AS row_no, file_id, "offset", value_size, arrived_at AS ts FROM wal WHERE {_READABLE} AND vtype = 1
  UNION ALL
  SELECT DISTINCT 'sst', s.db_id, s.sst_id, s.pos, s.file_id, s."offset", s.value_size, l.created_at
  FROM sst s JOIN listed l ON s.db_id = l.db_id AND s.sst_id = l.file_id WHERE s.vtype = 1),
gone AS (SELECT db_id, file_id, min(dropped_at) AS gone FROM segments WHERE dropped_at IS NOT NULL GROUP BY ALL),
target AS (
  SELECT v.db_id, v.file_id, v."offset", octet_length(encode(v.value)) AS value_size, min(v.arrived_at) AS born, min(g.gone) AS gone
  FROM vlog v LEFT JOIN gone g ON v.db_id = g.db_id AND v.file_id = g.file_id WHERE v.value IS NOT NULL GROUP BY ALL),
lost AS (
  SELECT DISTINCT ref_table, db_id, holder_id, row_no, ts FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM target t WHERE t.db_id = r.db_id AND t.file_id = r.file_id AND t."offset" = r."offset" AND t.value_size = r.value_size
    AND t.born <= r.ts AND (t.gone IS NULL OR t.gone > r.ts)))
"""
_CURRENT = f"""
corrected AS (SELECT * FROM wal WHERE {_READABLE} QUALIFY row_number() OVER (PARTITION BY db_id, seq ORDER BY wal_id DESC, rec_no DESC) = 1),
winner AS (SELECT * FROM corrected QUALIFY row_number() OVER (PARTITION BY db_id, key ORDER BY seq DESC) = 1)
"""
_PENDING = f"""
{_LISTED},
content AS (
  SELECT 'wal' AS feed, db_id, seq, key, vtype, CASE WHEN vtype = 1 THEN {{'file_id': file_id, 'offset': "offset", 'value_size': value_size}} END AS ptr, arrived_at AS seen_at FROM wal WHERE {_READABLE}
  UNION ALL
  SELECT 'sst', s.db_id, s.seq, s.key, s.vtype, CASE WHEN s.vtype = 1 THEN {{'file_id': s.file_id, 'offset': s."offset", 'value_size': s.value_size}} END, l.created_at
  FROM sst s JOIN listed l ON s.db_id = l.db_id AND s.sst_id = l.file_id),
born AS (SELECT feed, db_id, seq, key, vtype, ptr, min(seen_at) AS seen_at FROM content GROUP BY ALL),
run AS (SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC) = 1),
reads AS (SELECT feed, max(read_at) AS t FROM run WHERE lower(trim(status)) = 'succeeded' AND finished_at IS NOT NULL GROUP BY feed),
pending AS (SELECT b.* FROM born b LEFT JOIN reads r ON b.feed = r.feed WHERE r.t IS NULL OR b.seen_at > r.t)
"""

ORACLE = {
    "p1_found": f"WITH {_SMALL} SELECT db_id, file_id FROM tiny WHERE n >= 2",
    "p1_entries": f"""WITH {_SMALL} SELECT e.db_id, t.level, e.key, e.vtype, e.seq, e.file_id, e."offset", e.value_size
        FROM entry e JOIN tiny t ON e.db_id = t.db_id AND e.sst_id = t.file_id WHERE t.n >= 2""",
    "p1_compact": f"""WITH {_SMALL} SELECT e.db_id, l.level, e.key, e.vtype, e.seq, e.file_id, e."offset", e.value_size
        FROM (SELECT DISTINCT * EXCLUDE (level) FROM entry) e JOIN listed l ON e.db_id = l.db_id AND e.sst_id = l.file_id WHERE l.removed_at IS NULL""",
    "p1_levels": f"""WITH {_SMALL}, counted AS (SELECT db_id, sst_id, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (level) FROM entry) GROUP BY ALL)
        SELECT l.db_id, l.level, count(*) AS files_before,
          count(*) - count(t.file_id) FILTER (WHERE t.n >= 2) + count(DISTINCT CASE WHEN t.n >= 2 AND c.n > 0 THEN 1 END) AS files_after,
          CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS entries_before, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS entries_after
        FROM listed l LEFT JOIN tiny t ON l.db_id = t.db_id AND l.file_id = t.file_id LEFT JOIN counted c ON l.db_id = c.db_id AND l.file_id = c.sst_id
        WHERE l.removed_at IS NULL GROUP BY ALL""",
    "p2_found": f"WITH {_PENDING} SELECT DISTINCT feed, db_id, seq FROM pending",
    "p2_replayed": f'WITH {_PENDING} SELECT feed, db_id, seq, key, vtype, ptr.file_id AS file_id, ptr."offset" AS "offset", ptr.value_size AS value_size FROM pending',
    "p3_found": f"WITH {_CURRENT} SELECT db_id, wal_id, rec_no FROM winner WHERE vtype = 1",
    "p3_state": f'WITH {_CURRENT} SELECT db_id, key, seq, file_id, "offset", value_size FROM winner WHERE vtype = 1',
    "p3_partial": f"""WITH {_CURRENT},
        feed AS (
          SELECT db_id, key, seq, CASE WHEN vtype = 2 THEN 2 WHEN seq % 5 = 0 THEN 1 ELSE 3 END AS kind,
            CASE WHEN seq % 5 = 0 OR seq % 2 = 0 THEN "offset" END AS o, CASE WHEN seq % 5 = 0 OR (seq % 2 <> 0 AND seq % 3 = 0) THEN value_size END AS v,
            CASE WHEN seq % 5 = 0 OR (seq % 2 <> 0 AND seq % 3 <> 0) THEN file_id END AS f FROM corrected),
        bar AS (SELECT db_id, key, max(seq) FILTER (WHERE kind <> 3) AS bar, max(seq) FILTER (WHERE kind = 2) AS del, max(seq) AS last FROM feed GROUP BY ALL),
        counting AS (SELECT f.*, b.last FROM feed f JOIN bar b ON b.db_id = f.db_id AND b.key = f.key WHERE b.last > coalesce(b.del, b.last - 1) AND f.seq >= coalesce(b.bar, f.seq) AND f.kind <> 2)
        SELECT db_id, key, last AS seq, arg_max_null(f, seq) FILTER (WHERE kind = 1 OR f IS NOT NULL) AS file_id, arg_max_null(o, seq) FILTER (WHERE kind = 1 OR o IS NOT NULL) AS "offset",
          arg_max_null(v, seq) FILTER (WHERE kind = 1 OR v IS NOT NULL) AS value_size FROM counting GROUP BY ALL""",
    "p4_found": f"WITH {_REFS} SELECT DISTINCT ref_table, db_id, holder_id, row_no FROM lost",
    "p4_by_day": f"""WITH {_REFS} SELECT ref_table, db_id, CAST(ts AS DATE) AS day, count(*) AS orphans
        FROM (SELECT ref_table, db_id, holder_id, row_no, min(ts) AS ts FROM lost GROUP BY ALL) GROUP BY ALL""",
    "p4_runs": f"WITH {_REFS} SELECT DISTINCT ref_table, db_id, holder_id, row_no FROM lost",
    "p4_current": f"""WITH {_REFS} SELECT r.db_id, r.file_id, r."offset", r.value_size, count(*) AS refs FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.db_id = r.db_id AND t.file_id = r.file_id AND t."offset" = r."offset" AND t.value_size = r.value_size AND t.gone IS NULL)
        GROUP BY ALL""",
}
