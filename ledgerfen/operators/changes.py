"""Applying a stream of inserts, updates and deletes: column-wise last writer wins, in SQL only.

A change has a key, a sequence number and a kind. A delete or a replacement sets the bar: only changes from it on count. Each
field has the value of the last change that set it. As the last change that sets a field overall is also the last from the bar
on, if there is any, one aggregation finds both, with partial results before the shuffle, so that a hot key is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apply_changes(changes: DataFrame, keys: list[str], seq: str, kind: str, fields: list[str], deletes: tuple = (2,), replaces: tuple = (1,)) -> DataFrame:
    """The current rows: keys, ``seq`` (of the last change) and ``fields`` of every key whose last bar isn't a delete.

    Kinds outside ``deletes`` and ``replaces`` are partial updates: they set the fields that aren't null. A replacement sets
    all its fields, nulls too. A partial update after a delete brings the row back with only its fields; one without any row
    before it creates the row. Changes of null ``seq`` or ``kind`` are no changes. Changes of a key with the same ``seq`` are
    taken as one: a delete among them wins, else the greatest value of each field. A null key is a key. Other columns of ``changes`` are ignored.
    """
    lit = lambda values: ", ".join(repr(v) for v in values) or "NULL"
    bar = f"{_q(kind)} IN ({lit((*deletes, *replaces))})"
    gone, whole = f"{_q(kind)} IN ({lit(deletes)})", f"{_q(kind)} IN ({lit(replaces)})"
    key_list = ", ".join(map(_q, keys))
    last = ", ".join(
        f"max(struct({_q(seq)} AS s, {_q(f)} AS v)) FILTER (WHERE NOT ({gone}) AND ({whole} OR {_q(f)} IS NOT NULL)) AS f{i}" for i, f in enumerate(fields)
    )
    out = ", ".join(f"CASE WHEN f{i}.s >= coalesce(bar, f{i}.s) THEN f{i}.v END AS {_q(f)}" for i, f in enumerate(fields))
    return changes.sparkSession.sql(
        f"""
        SELECT {key_list}, last AS {_q(seq)}, {out}
        FROM (
          SELECT {key_list}, max({_q(seq)}) AS last, max({_q(seq)}) FILTER (WHERE {bar}) AS bar,
                 max({_q(seq)}) FILTER (WHERE {gone}) AS del, max({_q(seq)}) FILTER (WHERE NOT ({gone})) AS alive
                 {"," if fields else ""} {last}
          FROM {{changes}} WHERE {_q(seq)} IS NOT NULL AND {_q(kind)} IS NOT NULL
          GROUP BY {key_list}
        ) WHERE alive > coalesce(del, alive - 1)
        """,
        changes=changes,
    )


def last_corrections(wal: DataFrame) -> DataFrame:
    """Of the readable records of a (db_id, seq) the last in log order, with ``ptr``, its pointer. Whole repeats change nothing."""
    return wal.sparkSession.sql(
        """
        SELECT db_id, seq, r.key AS key, r.vtype AS vtype, r.wal_id AS wal_id, r.rec_no AS rec_no,
               r.file_id AS file_id, r.offset AS offset, r.value_size AS value_size
        FROM (
          SELECT db_id, seq, max(struct(wal_id, rec_no, key, vtype, file_id, offset, value_size)) AS r
          FROM {wal}
          WHERE db_id IS NOT NULL AND seq IS NOT NULL AND key IS NOT NULL
            AND len = octet_length(key) + CASE vtype WHEN 1 THEN 29 WHEN 2 THEN 13 END
          GROUP BY db_id, seq
        )
        """,
        wal=wal,
    )


def current_state(wal: DataFrame) -> DataFrame:
    """(db_id, key, seq, wal_id, rec_no, pointer) of every live key of a log with repeats, corrections and late records.

    A put replaces the whole row and a delete removes it. Torn records and records without a database count as not there.
    """
    fields = ["wal_id", "rec_no", "file_id", "offset", "value_size"]
    return apply_changes(last_corrections(wal), ["db_id", "key"], "seq", "vtype", fields)
