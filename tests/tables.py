"""Small tables of the store for tests."""

from datetime import datetime, timedelta

T0 = datetime(2025, 3, 1)
WAL = "db_id long, wal_id long, rec_no long, crc long, len long, vtype int, seq long, key string, file_id long, offset long, value_size long, arrived_at timestamp"
VLOG = "db_id long, file_id long, offset long, rec_size long, crc long, vtype int, key string, value string, arrived_at timestamp"
SST = "db_id long, level int, sst_id long, pos long, key string, vtype int, seq long, file_id long, offset long, value_size long"
MANIFEST = "db_id long, file_id long, level int, num_entries long, file_size long, smallest_key string, largest_key string, created_at timestamp, removed_at timestamp, listed_at timestamp"
SEGMENTS = "db_id long, file_id long, records long, bytes long, sealed_at timestamp, dropped_at timestamp"
RUNS = "run_id long, feed string, started_at timestamp, read_at timestamp, finished_at timestamp, status string, recorded_at timestamp"


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def put(db, wal, rec, seq, key, ptr=(1, 0, 1), t=0, torn=False):
    n = None if key is None else len(key.encode()) + 29 + (1 if torn else 0)
    return db, wal, rec, 0, n, 1, seq, key, *ptr, at(t)


def delete(db, wal, rec, seq, key, t=0):
    return db, wal, rec, 0, None if key is None else len(key.encode()) + 13, 2, seq, key, None, None, None, at(t)


def with_extra(df):
    """``df`` with columns whose names operators may use inside."""
    from pyspark.sql import functions as F

    names = ["_last", "_first", "_part", "_one", "block", "version", "seen_at", "bar", "last", "level_", "row", "reach", "main", "n"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))
