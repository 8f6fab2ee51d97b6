"""SQL for the queries of ``store``, written independently of them."""

from __future__ import annotations

from .general import _CURRENT, _LISTED, _READABLE

_BYTES = "octet_length(encode({}))".format
_WE = """we AS (SELECT event_id + 1 AS seq, 'user_' || user_id AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS vtype,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"""
_WL = """wl AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
    'order_' || l_orderkey AS key, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS vtype,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus || '|' || l_linenumber END AS value FROM lineitem)"""


def _last(log: str, keys: str = "key", name: str = "last") -> str:
    return f"{name} AS (SELECT * FROM {log} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) = 1)"


_E, _L = f"WITH {_WE}, {_last('we')}", f"WITH {_WL}, {_last('wl')}"
_STATUS = "CASE vtype WHEN 1 THEN 'OK' WHEN 2 THEN 'NotFound: Key deleted' ELSE 'NotFound: Key not found' END"


def _rotation(source: str, extra: str) -> str:
    return f"""WITH RECURSIVE {source},
        put AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, key, {_BYTES("value")} AS value_size, {_BYTES("key")} + {_BYTES("value")} + 13 AS rec_size FROM {extra}),
        fold AS (
          SELECT n, CAST(1 AS BIGINT) AS file_id, CAST(0 AS BIGINT) AS "offset", rec_size FROM put WHERE n = 1
          UNION ALL
          SELECT p.n, CASE WHEN f."offset" + f.rec_size + p.rec_size > 4096 THEN f.file_id + 1 ELSE f.file_id END,
                 CASE WHEN f."offset" + f.rec_size + p.rec_size > 4096 THEN 0 ELSE f."offset" + f.rec_size END, p.rec_size
          FROM fold f JOIN put p ON p.n = f.n + 1)
        SELECT p.seq, p.key, p.value_size, p.rec_size, f.file_id, f."offset" FROM fold f JOIN put p ON p.n = f.n"""


_RUNS = f"""WITH RECURSIVE {_WE}, o AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, key, vtype FROM we),
    fold AS (
      SELECT n, CAST(1 AS BIGINT) AS run_id, [key] AS keys, length(key) + 88 AS used FROM o WHERE n = 1
      UNION ALL
      SELECT o.n, CASE WHEN f.used >= 2048 THEN f.run_id + 1 ELSE f.run_id END,
             CASE WHEN f.used >= 2048 THEN [o.key] WHEN list_contains(f.keys, o.key) THEN f.keys ELSE list_append(f.keys, o.key) END,
             CASE WHEN f.used >= 2048 THEN length(o.key) + 88 WHEN list_contains(f.keys, o.key) THEN f.used ELSE f.used + length(o.key) + 88 END
      FROM fold f JOIN o ON o.n = f.n + 1),
    run AS (SELECT o.*, f.run_id FROM fold f JOIN o ON o.n = f.n),
    flushed AS (
      SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos, key, seq, vtype
      FROM (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1))"""

_SIZED = f"""entry AS (SELECT DISTINCT db_id, sst_id, pos, key, vtype, seq, file_id, "offset", value_size, {_BYTES("key")} AS k FROM sst),
    sized AS (SELECT *, k + 25 + CASE WHEN k >= 128 THEN 2 ELSE 1 END AS size FROM entry)"""
_INDEX = f"""WITH {_SIZED},
    placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY db_id, sst_id ORDER BY pos) - size AS BIGINT) AS data_offset, CAST(sum(size) OVER (PARTITION BY db_id, sst_id) AS BIGINT) AS data_end FROM sized),
    idx AS (SELECT db_id, sst_id, key, data_offset, coalesce(lead(data_offset) OVER (PARTITION BY db_id, sst_id ORDER BY pos), data_end) AS block_end FROM placed WHERE pos % 16 = 0)"""

_CUR = f"""{_LISTED}, cur AS (SELECT DISTINCT s.db_id, s.sst_id, s.pos, s.key, s.vtype, s.seq, s.file_id, s."offset", s.value_size, l.level
    FROM sst s JOIN listed l ON s.db_id = l.db_id AND s.sst_id = l.file_id WHERE l.removed_at IS NULL)"""


def _inputs(level: int) -> str:
    return f"""hull AS (SELECT db_id, min(smallest_key) AS lo, max(largest_key) AS hi FROM listed WHERE removed_at IS NULL AND level = {level} GROUP BY db_id),
    input AS (
      SELECT db_id, file_id, level FROM listed WHERE removed_at IS NULL AND level = {level}
      UNION ALL SELECT l.db_id, l.file_id, l.level FROM listed l JOIN hull h ON l.db_id = h.db_id
      WHERE l.removed_at IS NULL AND l.level = {level + 1} AND l.smallest_key <= h.hi AND l.largest_key >= h.lo)"""


_MERGED = f"""WITH {_CUR}, {_inputs(0)},
    newest AS (SELECT c.* FROM cur c JOIN input i ON c.db_id = i.db_id AND c.sst_id = i.file_id
      QUALIFY row_number() OVER (PARTITION BY c.db_id, c.key ORDER BY c.seq DESC) = 1),
    merged AS (SELECT *, vtype = 2 AND NOT EXISTS (SELECT 1 FROM cur d WHERE d.db_id = n.db_id AND d.key = n.key AND d.level >= 2) AS dropped FROM newest n)"""

_GARBAGE = f"""{_CURRENT},
    rec AS (SELECT db_id, file_id, "offset", key, value, {_BYTES("key")} + {_BYTES("value")} + 13 AS rec_size FROM vlog v
      WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.db_id = v.db_id AND s.file_id = v.file_id AND s.dropped_at IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY db_id, file_id, "offset" ORDER BY key DESC, value DESC) = 1),
    marked AS (SELECT r.*, w.key IS NOT NULL AS live FROM rec r LEFT JOIN winner w
      ON w.vtype = 1 AND w.db_id = r.db_id AND w.file_id = r.file_id AND w."offset" = r."offset" AND w.key = r.key),
    ratio AS (SELECT db_id, file_id, CAST(sum(rec_size) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN live THEN rec_size ELSE 0 END) AS BIGINT) AS live_bytes,
      1 - CAST(sum(CASE WHEN live THEN rec_size ELSE 0 END) AS DOUBLE) / CAST(sum(rec_size) AS DOUBLE) AS ratio FROM marked GROUP BY ALL),
    cand AS (SELECT db_id, file_id, ratio, ratio >= 0.5 AS due FROM ratio QUALIFY file_id = min(file_id) OVER (PARTITION BY db_id) AND file_id < max(file_id) OVER (PARTITION BY db_id))"""
_MOVED = f"""WITH RECURSIVE {_GARBAGE},
    tail AS (SELECT db_id, file_id AS f0, "offset" + rec_size AS o0 FROM marked QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY file_id DESC, "offset" DESC) = 1),
    todo AS (SELECT m.*, row_number() OVER (PARTITION BY m.db_id ORDER BY m.file_id, m."offset") AS n FROM marked m JOIN cand c ON c.db_id = m.db_id AND c.file_id = m.file_id WHERE m.live AND c.due),
    fold AS (
      SELECT db_id, CAST(0 AS BIGINT) AS n, f0 AS nf, CAST(0 AS BIGINT) AS no, o0 AS used FROM tail
      UNION ALL
      SELECT t.db_id, t.n, CASE WHEN f.used + t.rec_size > 2048 AND f.used > 0 THEN f.nf + 1 ELSE f.nf END,
        CASE WHEN f.used + t.rec_size > 2048 AND f.used > 0 THEN 0 ELSE f.used END, CASE WHEN f.used + t.rec_size > 2048 AND f.used > 0 THEN t.rec_size ELSE f.used + t.rec_size END
      FROM fold f JOIN todo t ON t.db_id = f.db_id AND t.n = f.n + 1),
    moved AS (SELECT t.db_id, t.file_id, t."offset", t.key, t.rec_size, t.n AS seq_step, f.nf AS new_file_id, f.no AS new_offset FROM fold f JOIN todo t ON t.db_id = f.db_id AND t.n = f.n)"""

_PREFIX = f"""bad AS (SELECT db_id, wal_id, min(rec_no) AS first_torn FROM wal WHERE ({_READABLE}) IS NOT TRUE GROUP BY ALL),
    good AS (SELECT DISTINCT w.db_id, w.wal_id, w.rec_no, w.vtype, w.seq, w.key, w.file_id, w."offset", w.value_size FROM wal w LEFT JOIN bad b ON w.db_id = b.db_id AND w.wal_id = b.wal_id
      WHERE b.first_torn IS NULL OR w.rec_no < b.first_torn)"""


def _commands(put: str, get: str, delete: str, other: str, instead: str = "NULL") -> str:
    return f"""cmd AS (SELECT event_id AS line_no, coalesce({instead}, CASE event_type WHEN 'purchase' THEN '{put}' WHEN 'error' THEN '{delete}' WHEN 'signup' THEN '{other}' ELSE '{get}' END) AS verb,
        'user_' || user_id AS key, CASE WHEN event_type = 'purchase' THEN regexp_extract(trim(props), '^\\S+') ELSE '' END AS value FROM events),
    asked AS (SELECT *, last_value(CASE WHEN verb IN ('{put}', '{delete}') THEN {{'verb': verb, 'value': value}} END IGNORE NULLS)
        OVER (PARTITION BY key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM cmd)"""


_CRC = """bit AS (SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT for x in range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    tab AS (SELECT list(v ORDER BY i) AS t FROM bit)"""


def _crc(blob: str) -> str:
    return f"xor(list_reduce([4294967295::UBIGINT] || {blob}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"


def _le(value: str, n: int) -> str:
    return f"[(({value}) >> (8 * i)) & 255 for i in range({n})]"


_KEY_BYTES = "[('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT for i in range(octet_length(encode(key)))]"
_BODY = f"""(list_concat({_le("len", 4)}, [vtype::BIGINT], {_le("seq", 8)}, {_le("octet_length(encode(key))", 4)}, {_KEY_BYTES},
    CASE WHEN vtype = 1 THEN list_concat({_le("file_id", 4)}, {_le('"offset"', 8)}, {_le("value_size", 4)}) ELSE [] END))::UBIGINT[]"""

_VALUE_BYTES = _KEY_BYTES.replace("key", "value")
_VALUE_BODY = f"""(list_concat([vtype::BIGINT], {_le("octet_length(encode(key))", 4)}, {_KEY_BYTES}, {_le("octet_length(encode(value))", 4)}, {_VALUE_BYTES}))::UBIGINT[]"""

_M = "4294967295::UBIGINT"


def _rotl(x: str, n: int) -> str:
    return f"((({x}) << {n}) & {_M}) | (({x}) >> {32 - n})"


def _scrambled(k: str) -> str:
    return f"((({_rotl(f'(({k}) * 3432918353::UBIGINT) & {_M}', 15)}) * 461845907::UBIGINT) & {_M})"


def _mixed(h: str) -> str:
    a = f"xor({h}, ({h}) >> 16)"
    return f"list_reduce([{a}, 2246822507::UBIGINT, 3266489909::UBIGINT], lambda x, c: CASE WHEN c = 2246822507::UBIGINT THEN xor((x * c) & {_M}, ((x * c) & {_M}) >> 13) ELSE xor((x * c) & {_M}, ((x * c) & {_M}) >> 16) END)"


def _murmur(seed: int) -> str:
    """The 32-bit hash of a list ``b`` of bytes: whole blocks, then the rest, then the final mixing."""
    block = "b[4 * i + 1] + (b[4 * i + 2] << 8) + (b[4 * i + 3] << 16) + (b[4 * i + 4] << 24)"
    rest = "coalesce(b[4 * (len(b) // 4) + 1], 0) + (coalesce(CASE WHEN len(b) % 4 > 1 THEN b[4 * (len(b) // 4) + 2] END, 0) << 8) + (coalesce(CASE WHEN len(b) % 4 > 2 THEN b[4 * (len(b) // 4) + 3] END, 0) << 16)"
    body = f"list_reduce([{seed}::UBIGINT] || [{_scrambled(block)} for i in range(len(b) // 4)], lambda h, k: (({_rotl('xor(h, k)', 13)}) * 5 + 3864292196::UBIGINT) & {_M})"
    tail = f"CASE WHEN len(b) % 4 > 0 THEN {_scrambled(rest)} ELSE 0::UBIGINT END"
    return _mixed(f"xor(xor({body}, {tail}), len(b)::UBIGINT)")


_BLOOM = f"""own AS (SELECT DISTINCT db_id, sst_id, key FROM sst),
    sized AS (SELECT db_id, sst_id, (ceil(greatest(64, 10 * count(key)) / 8) * 8)::UBIGINT AS m FROM own WHERE key IS NOT NULL GROUP BY ALL),
    asked AS (SELECT db_id, sst_id, key, true AS mine FROM own UNION ALL SELECT db_id, sst_id, key || '#', false FROM own),
    bytes AS (SELECT key, ({_KEY_BYTES})::UBIGINT[] AS b FROM (SELECT DISTINCT key FROM asked WHERE key IS NOT NULL)),
    hashed AS (SELECT key, {_murmur(0xBC9F1D34)} AS h1, {_murmur(0xEF017832)} AS h2 FROM bytes),
    bit AS (SELECT a.db_id, a.sst_id, a.key, a.mine, unnest([(h.h1 + i::UBIGINT * h.h2) % s.m for i in range(6)]) AS p
      FROM asked a JOIN sized s ON a.db_id = s.db_id AND a.sst_id = s.sst_id JOIN hashed h ON a.key = h.key),
    filled AS (SELECT DISTINCT db_id, sst_id, p FROM bit WHERE mine),
    answer AS (SELECT b.db_id, b.sst_id, b.key, bool_and(f.p IS NOT NULL) AS maybe, bool_or(b.mine) AS mine
      FROM bit b LEFT JOIN filled f ON f.db_id = b.db_id AND f.sst_id = b.sst_id AND f.p = b.p GROUP BY ALL)"""

ORACLE = {
    "kv_latest_state": f"{_E} SELECT key, seq, value FROM last WHERE vtype = 1",
    "kv_latest_state_lines": f"{_L} SELECT key, seq, value FROM last WHERE vtype = 1",
    "kv_snapshot": f"WITH {_WE}, old AS (SELECT * FROM we WHERE seq <= 3000), {_last('old')} SELECT key, seq, value FROM last WHERE vtype = 1",
    "kv_point_get": f"{_E} SELECT 'user_7' AS key, {_STATUS} AS status, value FROM (SELECT 1) LEFT JOIN last ON key = 'user_7'",
    "kv_multi_get": f"{_E}, wanted AS (SELECT DISTINCT 'user_' || c_custkey AS key FROM customer) SELECT w.key, {_STATUS} AS status, value FROM wanted w LEFT JOIN last USING (key)",
    "kv_put_delete_batch": f"""WITH {_WE}, b AS (SELECT seq // 100 AS batch_id, * EXCLUDE (seq), row_number() OVER (ORDER BY seq // 100, seq % 100) AS seq FROM we), {_last("b", "batch_id, key")}
        SELECT batch_id, key, seq, vtype, value FROM last""",
    "kv_range_scan": f"{_L} SELECT row_number() OVER (ORDER BY key) AS pos, key, value FROM last WHERE vtype = 1 AND key BETWEEN 'order_2' AND 'order_5'",
    "kv_prefix_scan": f"{_E} SELECT row_number() OVER (ORDER BY key) AS pos, key, value FROM last WHERE vtype = 1 AND starts_with(key, 'user_1')",
    "kv_reverse_scan": f"{_E} SELECT row_number() OVER (ORDER BY key DESC) AS pos, key, value FROM last WHERE vtype = 1",
    "kv_seek": f"""{_E} SELECT target, (SELECT min(key) FROM last WHERE vtype = 1 AND key >= target) AS "at", (SELECT max(key) FROM last WHERE vtype = 1 AND key < target) AS before
        FROM (VALUES (''), ('user_11'), ('user_5'), ('user_9999'), ('zzz')) t(target)""",
    "kv_tombstones": f"{_L} SELECT key, seq FROM last WHERE vtype = 2",
    "kv_version_history": f"""WITH {_WE} SELECT key, seq, vtype, row_number() OVER w AS version, lead(seq) OVER w AS next_seq, CAST(coalesce({_BYTES("value")}, 0) AS BIGINT) AS bytes
        FROM we WINDOW w AS (PARTITION BY key ORDER BY seq)""",
    "vlog_layout": _rotation(_WE, "we WHERE vtype = 1"),
    "vlog_layout_large": _rotation("wd AS (SELECT doc_id + 1 AS seq, coalesce(lang, '') || '/' || coalesce(source, '') AS key, coalesce(text, '') AS value FROM documents)", "wd"),
    "vlog_deref": f"""WITH {_CURRENT}, {_CRC}, rec AS (SELECT * FROM vlog QUALIFY row_number() OVER (PARTITION BY db_id, file_id, "offset" ORDER BY arrived_at DESC, value DESC, crc DESC NULLS LAST) = 1),
        summed AS (SELECT r.*, coalesce(crc <> {_crc(_VALUE_BODY)}, false) AS wrong FROM rec r, tab)
        SELECT w.db_id, w.key, CASE WHEN r.db_id IS NULL THEN 'NotFound: No record' WHEN ({_BYTES("r.value")} = w.value_size) IS NOT TRUE THEN 'Corruption: Value size' WHEN r.wrong THEN 'Corruption: Checksum' ELSE 'OK' END AS status,
          CASE WHEN {_BYTES("r.value")} = w.value_size AND NOT r.wrong THEN r.value END AS value
        FROM winner w LEFT JOIN summed r ON r.db_id = w.db_id AND r.file_id = w.file_id AND r."offset" = w."offset" WHERE w.vtype = 1""",
    "crc32c_values": f"""WITH {_CRC}, c AS (SELECT db_id, file_id, "offset", crc, {_crc(_VALUE_BODY)} AS computed FROM (SELECT DISTINCT db_id, file_id, "offset", crc, vtype, key, value FROM vlog WHERE value IS NOT NULL), tab)
        SELECT DISTINCT *, crc = computed AS ok FROM c""",
    "gc_refused": f"""WITH {_GARBAGE}, {_CRC},
        rows AS (SELECT DISTINCT v.db_id, v.file_id, v."offset", v.crc, v.vtype, v.key, CASE WHEN v.db_id % 2 = 0 AND v."offset" % 3 = 0 THEN v.value || '!' ELSE v.value END AS value
          FROM vlog v JOIN cand c ON c.db_id = v.db_id AND c.file_id = v.file_id WHERE c.due AND v.value IS NOT NULL),
        bad AS (SELECT db_id, file_id, count(*) AS bad FROM (SELECT DISTINCT db_id, file_id, "offset", crc, {_crc(_VALUE_BODY)} AS computed FROM rows, tab) WHERE crc <> computed GROUP BY ALL)
        SELECT c.db_id, c.file_id, coalesce(b.bad, 0) AS bad, b.bad IS NULL AS reclaimed FROM cand c LEFT JOIN bad b ON b.db_id = c.db_id AND b.file_id = c.file_id WHERE c.due""",
    "codec_decode": """SELECT DISTINCT key, seq, key AS text, seq AS number, true AS cut_fails, true AS overlong_fails FROM sst WHERE key IS NOT NULL AND seq IS NOT NULL""",
    "wal_valid_prefix": f"WITH {_PREFIX} SELECT db_id, wal_id, rec_no, seq, key, vtype FROM good",
    "wal_replay_state": f"""WITH {_PREFIX} SELECT db_id, key, seq, wal_id, rec_no, file_id, "offset", value_size
        FROM (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY db_id, key ORDER BY wal_id DESC, rec_no DESC) = 1) WHERE vtype = 1""",
    "wal_next_seq": f"""WITH {_PREFIX} SELECT f.db_id, coalesce(g.top, 0) + 1 AS next_seq, f.top + 1 AS next_wal_id
        FROM (SELECT db_id, max(wal_id) AS top FROM wal GROUP BY 1) f LEFT JOIN (SELECT db_id, max(seq) AS top FROM good GROUP BY 1) g USING (db_id)""",
    "crc32c_records": f"""WITH {_CRC}, rec AS (SELECT DISTINCT db_id, wal_id, rec_no, crc, len, vtype, seq, key, file_id, "offset", value_size FROM wal WHERE {_READABLE}),
        c AS (SELECT db_id, wal_id, rec_no, crc, {_crc(_BODY)} AS computed FROM rec, tab) SELECT DISTINCT *, coalesce(crc = computed, false) AS ok FROM c""",
    "wal_file_round_trip": f'WITH {_PREFIX} SELECT db_id, wal_id, seq, key, vtype, CASE WHEN vtype = 1 THEN file_id END AS file_id, CASE WHEN vtype = 1 THEN "offset" END AS "offset", CASE WHEN vtype = 1 THEN value_size END AS value_size FROM good',
    "memtable_runs": f"{_RUNS} SELECT seq, key, vtype, run_id FROM run",
    "memtable_usage": f"{_RUNS} SELECT run_id, count(DISTINCT key) AS entries, CAST(sum(length(key) + 88) AS BIGINT) AS bytes FROM (SELECT DISTINCT run_id, key FROM run) GROUP BY run_id",
    "flush_l0": f"{_RUNS} SELECT run_id, pos, key, seq, vtype FROM flushed",
    "sst_manifest": f"""{_RUNS} SELECT run_id, count(*) AS num_entries, min(key) AS smallest_key, max(key) AS largest_key,
        CAST(sum(length(key) + 26 + CASE WHEN pos % 16 = 0 THEN length(key) + 9 ELSE 0 END) + 4 + ceil(greatest(64, 10 * count(*)) / 8) + 48 AS BIGINT) AS file_size FROM flushed GROUP BY run_id""",
    "manifest_round_trip": f"""WITH {_LISTED} SELECT db_id, file_id, level, num_entries, coalesce(smallest_key, '') AS smallest_key, coalesce(largest_key, '') AS largest_key FROM listed l
        WHERE removed_at IS NULL AND EXISTS (SELECT 1 FROM sst s WHERE s.db_id = l.db_id AND s.sst_id = l.file_id)""",
    "sst_sorted": """WITH e AS (SELECT DISTINCT db_id, sst_id, pos, key FROM sst), b AS (SELECT *, lag(key) OVER (PARTITION BY db_id, sst_id ORDER BY pos) AS before FROM e)
        SELECT db_id, sst_id, count(*) FILTER (WHERE before > key) AS bad FROM b GROUP BY ALL""",
    "sst_round_trip": f"WITH {_CUR} SELECT db_id, sst_id, pos, key, seq FROM cur WHERE key BETWEEN 'order_' AND 'user'",
    "sparse_index": f"{_INDEX} SELECT * FROM idx",
    "sparse_lookup": f"""{_INDEX}, probe AS (SELECT DISTINCT db_id, sst_id, key || '!' AS key FROM sst UNION SELECT DISTINCT db_id, sst_id, '' FROM sst),
        lowest AS (SELECT db_id, sst_id, min({{'o': data_offset, 'e': block_end}}) AS b FROM idx GROUP BY ALL)
        SELECT p.db_id, p.sst_id, p.key, coalesce(i.data_offset, l.b.o) AS block, coalesce(i.block_end, l.b.e) AS block_end
        FROM probe p ASOF LEFT JOIN idx i ON p.db_id = i.db_id AND p.sst_id = i.sst_id AND p.key >= i.key JOIN lowest l ON l.db_id = p.db_id AND l.sst_id = p.sst_id""",
    "bloom_semi": f"WITH {_BLOOM} SELECT db_id, sst_id, count(*) AS probes, count(*) FILTER (WHERE maybe) AS maybe FROM answer GROUP BY ALL",
    "bloom_fpr": f"WITH {_BLOOM} SELECT db_id, count(*) AS probes, avg(maybe::INT::DOUBLE) AS false_positive_rate FROM answer WHERE NOT mine GROUP BY db_id",
    "layered_get": f"""WITH {_CUR} SELECT db_id, key, level, sst_id, seq, vtype FROM cur
        QUALIFY row_number() OVER (PARTITION BY db_id, key ORDER BY level, CASE WHEN level = 0 THEN -sst_id ELSE sst_id END, pos) = 1""",
    "memtable_get": f"""{_RUNS} SELECT key, CASE WHEN run_id = top THEN 'memtable' WHEN top - run_id <= 3 THEN 'immutable' ELSE 'table' END AS layer, run_id, seq, vtype
        FROM (SELECT *, max(run_id) OVER () AS top FROM flushed) QUALIFY row_number() OVER (PARTITION BY key ORDER BY run_id DESC) = 1""",
    "compact_overlap_inputs": f"WITH {_LISTED}, {_inputs(1)} SELECT * FROM input",
    "compact_merge": f'{_MERGED} SELECT db_id, key, seq, vtype, file_id, "offset", value_size FROM merged WHERE NOT dropped',
    "compact_tombstone_drop": f"{_MERGED} SELECT db_id, key, seq FROM merged WHERE dropped",
    "compact_split": _MERGED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
        ent AS (SELECT db_id, key, seq, {_BYTES("key")} + 25 + CASE WHEN {_BYTES("key")} >= 128 THEN 2 ELSE 1 END AS size, row_number() OVER (PARTITION BY db_id ORDER BY key) AS n FROM merged WHERE NOT dropped),
        fold AS (SELECT db_id, n, CAST(0 AS BIGINT) AS out_no, size AS used FROM ent WHERE n = 1
          UNION ALL SELECT e.db_id, e.n, CASE WHEN f.used >= 4096 THEN f.out_no + 1 ELSE f.out_no END, CASE WHEN f.used >= 4096 THEN e.size ELSE f.used + e.size END
          FROM fold f JOIN ent e ON e.db_id = f.db_id AND e.n = f.n + 1)
        SELECT e.db_id, f.out_no, e.key, e.seq FROM fold f JOIN ent e ON e.db_id = f.db_id AND e.n = f.n""",
    "compaction_policy": f"""WITH {_LISTED}, {_SIZED},
        bytes AS (SELECT db_id, sst_id, sum(size + CASE WHEN pos % 16 = 0 THEN size - 17 ELSE 0 END) + 4 + ceil(greatest(64, 10 * count(*)) / 8) + 48 AS bytes FROM sized GROUP BY ALL),
        have AS (SELECT l.db_id, l.level, count(*) AS files, sum(coalesce(b.bytes, 60)) AS bytes FROM listed l LEFT JOIN bytes b ON b.db_id = l.db_id AND b.sst_id = l.file_id WHERE l.removed_at IS NULL GROUP BY ALL),
        grid AS (SELECT DISTINCT l.db_id, CAST(v AS INT) AS level FROM listed l, range(7) r(v) WHERE l.removed_at IS NULL)
        SELECT g.db_id, g.level, coalesce(h.files, 0) AS files, CAST(coalesce(h.bytes, 0) AS BIGINT) AS bytes, CASE WHEN g.level > 0 THEN CAST(10485760 * pow(10, g.level - 1) AS BIGINT) END AS byte_limit,
          CASE WHEN g.level = 0 THEN coalesce(h.files, 0) >= 4 ELSE coalesce(h.bytes, 0) > 10485760 * pow(10, g.level - 1) END AS due
        FROM grid g LEFT JOIN have h ON h.db_id = g.db_id AND h.level = g.level""",
    "compact_range": f"WITH {_CUR} SELECT db_id, 6 AS level, key, seq, vtype FROM (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY db_id, key ORDER BY seq DESC) = 1) WHERE vtype = 1",
    "state_after_compaction": f"WITH {_CUR} SELECT db_id, key, seq FROM (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY db_id, key ORDER BY seq DESC) = 1) WHERE vtype = 1",
    "state_after_replay": f"{_E} SELECT key, seq, coalesce(value, '') AS value FROM last WHERE vtype = 1",
    "gc_segment_ratio": f"WITH {_GARBAGE} SELECT * FROM ratio",
    "gc_candidate": f"WITH {_GARBAGE} SELECT * FROM cand",
    "gc_rewrite": f"{_MOVED} SELECT * FROM moved",
    "state_after_gc": f"""{_MOVED} SELECT w.db_id, w.key, coalesce(m.new_file_id, w.file_id) AS file_id, coalesce(m.new_offset, w."offset") AS "offset", w.value_size
        FROM winner w LEFT JOIN moved m ON m.db_id = w.db_id AND m.key = w.key AND m.file_id = w.file_id AND m."offset" = w."offset" WHERE w.vtype = 1""",
    "db_stats": f"""WITH {_LISTED}, dbs AS (SELECT DISTINCT db_id FROM wal UNION SELECT db_id FROM vlog UNION SELECT db_id FROM manifest),
        seqs AS (SELECT db_id, max(seq) + 1 AS v FROM wal WHERE {_READABLE} GROUP BY 1),
        every AS (SELECT db_id, wal_id, count(DISTINCT key) AS v, max(seq) AS top, max(wal_id) OVER (PARTITION BY db_id) AS last_log FROM wal WHERE {_READABLE} GROUP BY db_id, wal_id),
        charged AS (SELECT db_id, wal_id, sum({_BYTES("key")} + 88) AS bytes FROM (SELECT DISTINCT db_id, wal_id, key FROM wal WHERE {_READABLE}) GROUP BY ALL),
        logs AS (SELECT e.*, c.bytes FROM every e JOIN charged c USING (db_id, wal_id) WHERE wal_id = last_log),
        flushed AS (SELECT s.db_id, max(s.seq) AS top FROM sst s JOIN listed l ON s.db_id = l.db_id AND s.sst_id = l.file_id WHERE l.removed_at IS NULL GROUP BY ALL),
        waiting AS (SELECT e.db_id, count(*) AS v FROM every e LEFT JOIN flushed f USING (db_id) WHERE e.wal_id < e.last_log AND e.top > coalesce(f.top, -1) GROUP BY ALL),
        ends AS (SELECT db_id, file_id, "offset" + {_BYTES("key")} + {_BYTES("value")} + 13 AS e FROM vlog QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY file_id DESC, e DESC) = 1)
        SELECT db_id, 'sequence_number' AS metric, CAST(coalesce(v, 1) AS BIGINT) AS value FROM dbs LEFT JOIN seqs USING (db_id)
        UNION ALL SELECT db_id, 'active_memtable_count', coalesce(v, 0) FROM dbs LEFT JOIN logs USING (db_id)
        UNION ALL SELECT db_id, 'active_memtable_bytes', CAST(coalesce(bytes, 0) AS BIGINT) FROM dbs LEFT JOIN logs USING (db_id)
        UNION ALL SELECT db_id, 'immutable_memtables', coalesce(v, 0) FROM dbs LEFT JOIN waiting USING (db_id)
        UNION ALL SELECT db_id, 'memtable_limit', 4194304 FROM dbs
        UNION ALL SELECT db_id, 'vlog_file_id', coalesce(file_id, 1) FROM dbs LEFT JOIN ends USING (db_id)
        UNION ALL SELECT db_id, 'vlog_offset', coalesce(e, 0) FROM dbs LEFT JOIN ends USING (db_id)
        UNION ALL SELECT d.db_id, 'level_' || v || '_sstables', count(l.file_id) FROM dbs d CROSS JOIN range(7) r(v) LEFT JOIN listed l ON l.db_id = d.db_id AND l.level = v AND l.removed_at IS NULL GROUP BY d.db_id, v""",
    "protocol_parse": f"WITH {_commands('PUT', 'GET', 'DEL', 'PING')} SELECT line_no, verb, key, value FROM cmd",
    "protocol_reply": f"""WITH {_commands("PUT", "GET", "DEL", "PING")} SELECT line_no, CASE WHEN verb = 'PING' THEN '+PONG' || chr(13) || chr(10) WHEN verb IN ('PUT', 'DEL') THEN '+OK' || chr(13) || chr(10)
        WHEN found.verb = 'PUT' THEN '$' || {_BYTES("found.value")} || chr(13) || chr(10) || found.value || chr(13) || chr(10) ELSE '$-1' || chr(13) || chr(10) END AS reply FROM asked""",
    "cli_reply": f"""WITH {_commands("put", "get", "delete", "what", "CASE WHEN user_id % 10 = 0 THEN 'stats' WHEN user_id % 10 = 1 THEN 'compact' WHEN user_id % 10 = 2 THEN 'gc' WHEN user_id % 50 = 3 THEN 'put ' WHEN user_id % 50 = 13 THEN 'put!' END")},
        counted AS (SELECT *, count(*) FILTER (WHERE verb IN ('put', 'delete')) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM asked)
        SELECT line_no, CASE WHEN verb = 'put ' THEN 'Error: put requires key and value' WHEN verb = 'put!' THEN 'Unknown command: put!' WHEN verb IN ('put', 'delete', 'compact', 'gc') THEN 'OK'
          WHEN verb = 'stats' THEN 'sequence_number: ' || (before + 1) || chr(10) || 'memtable_limit: 4194304' WHEN verb = 'what' THEN 'Unknown command: what'
          WHEN found.verb = 'put' THEN found.value ELSE '(nil)' END AS reply FROM counted""",
    "codec_varint": """WITH x AS (SELECT l_orderkey, l_partkey, l_orderkey * l_partkey AS v FROM lineitem), n AS (SELECT *, greatest(1, ceil(length(ltrim(bin(v), '0')) / 7))::INT AS bytes FROM x)
        SELECT l_orderkey, l_partkey, bytes, array_to_string([format('{:02X}', ((v >> (7 * i)) & 127) + CASE WHEN i + 1 < bytes THEN 128 ELSE 0 END) for i in range(bytes)], '') AS digits FROM n""",
    "codec_fixed": """SELECT o_orderkey, array_to_string([format('{:02X}', ((o_orderkey * 7) >> (8 * i)) & 255) for i in range(4)], '') AS digits,
        array_to_string([format('{:02X}', (o_custkey >> (8 * i)) & 255) for i in range(8)], '') AS wide, o_orderkey * 7 AS again FROM orders""",
    "codec_pointer": f"""WITH d AS (SELECT DISTINCT key, file_id, "offset", value_size, {_BYTES("key")} AS k FROM sst),
        b AS (SELECT *, list_concat({_le("file_id", 4)}, {_le('"offset"', 8)}, {_le("value_size", 4)}) AS p FROM d)
        SELECT key, format('{{:02X}}', (k & 127) + CASE WHEN k >= 128 THEN 128 ELSE 0 END) || CASE WHEN k >= 128 THEN format('{{:02X}}', k >> 7) ELSE '' END || hex(encode(key)) AS prefixed,
          array_to_string([format('{{:02X}}', x) for x in p], '') AS digits, file_id, "offset", value_size FROM b""",
    "crc32c_keys": f"WITH {_CRC}, k AS (SELECT DISTINCT key FROM wal WHERE key IS NOT NULL) SELECT key, {_crc('(' + _KEY_BYTES + ')::UBIGINT[]')} AS crc FROM k, tab",
    "file_names": "SELECT DISTINCT db_id, file_id, format('vlog_{:05d}.dat', file_id) AS name, file_id AS number FROM segments",
    "stream_latest_state": f"{_E} SELECT key, seq, value FROM last WHERE vtype = 1",
}
