"""The SQL that each registered query must agree with, for DuckDB."""

from __future__ import annotations

from tidemark.plans.fixtures import ITEMS, NOW, PREFIXES, REQUESTS
from tidemark.plans.stores import GETS, LATER, PARTS

_GONE = "event_type = 'error' AND event_id % 3 = 0"
_TS = "CAST(floor(epoch(ts)) AS BIGINT)"

_ALL = f"""
WITH RECURSIVE log_all AS (
  SELECT event_id AS seq, {_TS} AS ts, 'user:' || lpad(CAST(user_id AS VARCHAR), 5, '0') || ':' || event_type AS key,
         CASE WHEN {_GONE} THEN NULL ELSE props END AS value,
         CASE WHEN event_id % 4 = 0 AND NOT ({_GONE}) THEN {_TS} + 86400 * (1 + event_id % 7) ELSE 0 END AS expire_at
  FROM events),
log AS (SELECT * FROM log_all WHERE ts <= {NOW}),
snap AS (SELECT key, seq, value, expire_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT * FROM snap WHERE value IS NOT NULL AND (expire_at = 0 OR {NOW} <= expire_at)),
req(pos, key) AS (VALUES {", ".join(f"(CAST({i} AS BIGINT), '{k}')" for i, k in enumerate(REQUESTS))}),
seg AS (SELECT key, seq, value, expire_at, seq // 1000 AS segment, 0 AS level FROM log_all WHERE seq >= 6000
        UNION ALL
        SELECT key, seq, value, expire_at, CASE WHEN key < 'user:00075' THEN -2 ELSE -1 END, 1
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log_all WHERE seq < 6000) WHERE rn = 1),
man AS (SELECT segment, level, min(key) AS min_key, max(key) AS max_key FROM seg GROUP BY ALL)"""

_IS_LIVE = f"value IS NOT NULL AND (expire_at = 0 OR {NOW} <= expire_at)"


def _newest(rows: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {rows}) WHERE rn = 1)"


def _literal(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


def _numbered(keys: tuple[str, ...]) -> str:
    return ", ".join(f"(CAST({i} AS BIGINT), '{k}')" for i, k in enumerate(keys))


_SHOWN = f"snap.key IS NOT NULL AND {_IS_LIVE}"
#: The log of the stores by range of seq, newest version per part.
_FLUSHED = f""", bounds AS (SELECT max(seq) AS top FROM log), dealt AS (SELECT log.*, k AS part FROM log, bounds, range({PARTS}) r(k) WHERE seq BETWEEN top * k // {PARTS} + CASE WHEN k > 0 THEN 1 ELSE 0 END AND top * (k + 1) // {PARTS}),
flushed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, key ORDER BY seq DESC) AS rn FROM dealt) WHERE rn = 1)"""
_ITEMS = ", ".join(f"(CAST({i} AS BIGINT), '{k}', {_literal(v)})" for i, (k, v) in enumerate(ITEMS))
_PREFIXES = ", ".join(f"('{p}')" for p in PREFIXES)
_BYTES = "octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)"
_CAS = f""", ops AS (SELECT event_id AS seq, 'user:' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS key,
        CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'click' ELSE 'view' END AS expected, event_type AS new_value,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
cas AS (SELECT seq, key, k, expected IS NOT DISTINCT FROM NULL AS success, CAST(NULL AS VARCHAR) AS current_value,
               CASE WHEN expected IS NULL THEN new_value END AS state FROM ops WHERE k = 1
        UNION ALL
        SELECT o.seq, o.key, o.k, o.expected IS NOT DISTINCT FROM c.state, c.state,
               CASE WHEN o.expected IS NOT DISTINCT FROM c.state THEN o.new_value ELSE c.state END
        FROM cas c JOIN ops o ON o.key = c.key AND o.k = c.k + 1)"""
_LIVE = "SELECT key, seq, value, expire_at FROM live"

ORACLES = {
    "kv_live": f"{_ALL} {_LIVE}",
    "kv_snapshot_as_of_seq": f"{_ALL} SELECT key, seq, value, expire_at FROM {_newest('(SELECT * FROM log_all WHERE seq <= 5000)')}",
    "kv_status_breakdown": f"{_ALL} SELECT CASE WHEN value IS NULL THEN 'deleted' WHEN expire_at > 0 AND {NOW} > expire_at THEN 'expired' ELSE 'live' END AS status, count(*) AS n FROM snap GROUP BY 1",
    "kv_get": f"{_ALL} SELECT key, value FROM live WHERE key = 'user:00001:click'",
    "kv_get_with_expire_at": f"{_ALL} SELECT key, value, expire_at FROM live WHERE key = 'user:00002:purchase'",
    "kv_get_expire_at": f"{_ALL} SELECT pos, req.key AS key, live.key IS NOT NULL AS exists, CAST(coalesce(expire_at, 0) AS BIGINT) AS expire_at FROM req LEFT JOIN live ON live.key = req.key",
    "kv_batch_get_ordered": f"{_ALL} SELECT pos, req.key AS key, value FROM req JOIN live ON live.key = req.key",
    "kv_batch_get_dedup": f"{_ALL} SELECT key, value FROM live WHERE key IN (SELECT key FROM req)",
    "kv_batch_get_bulk": f"{_ALL} SELECT key, value FROM live",
    "kv_count_prefix": f"{_ALL} SELECT count(*) AS n FROM live WHERE starts_with(key, 'user:0000')",
    "kv_count_all": f"{_ALL} SELECT count(*) AS n FROM live",
    "kv_count_multi_prefix": f"{_ALL} SELECT prefix, count(key) AS n FROM (VALUES {_PREFIXES}) p(prefix) LEFT JOIN live ON starts_with(key, prefix) GROUP BY prefix",
    "kv_scan_prefix": f"{_ALL} SELECT key, value, expire_at FROM live WHERE starts_with(key, 'user:0001')",
    "kv_scan_prefix_keys": f"{_ALL} SELECT key, value IS NULL AS is_tombstone FROM snap WHERE starts_with(key, 'user:0001')",
    "kv_set_ttl_visibility": f"{_ALL} SELECT CAST(delta AS INTEGER) AS delta, count(*) AS n FROM snap, (VALUES (-1), (0), (1)) t(delta) WHERE expire_at > 0 AND value IS NOT NULL AND expire_at + delta <= expire_at GROUP BY 1",
    "kv_set_expire_at_filter": f"{_ALL} SELECT expire_at = 0 OR expire_at > {NOW} AS accepted, count(*) AS n FROM log_all GROUP BY 1",
    "kv_batch_set_result": f"{_ALL}, items(pos, key, value) AS (VALUES {_ITEMS}) SELECT key, value, CAST({len(ITEMS)} AS BIGINT) AS submitted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS rn FROM items) WHERE rn = 1 AND value IS NOT NULL",
    "kv_delete_effect": f"{_ALL} SELECT key, value FROM live WHERE starts_with(key, 'user:0000') AND key NOT IN (SELECT key FROM req)",
    "kv_batch_delete_found": f"{_ALL} SELECT (SELECT count(*) FROM req) AS submitted, (SELECT count(*) FROM live WHERE key IN (SELECT key FROM req)) AS found",
    "kv_cas_log": f"{_ALL}{_CAS} SELECT seq, key, success, current_value FROM cas",
    "kv_cas_final": f"{_ALL}{_CAS} SELECT key, arg_max(state, k) AS value, max(seq) FILTER (success) AS seq FROM cas GROUP BY key HAVING max(seq) FILTER (success) IS NOT NULL",
    "kv_cas_nx": f"{_ALL} SELECT min(seq) + 10000000 AS seq, key, true AS success, CAST(NULL AS VARCHAR) AS current_value FROM log_all WHERE value IS NOT NULL AND key NOT IN (SELECT key FROM live) GROUP BY key",
    "kv_segment_stats": f"{_ALL} SELECT seq // 1000 AS segment, min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS entry_count, CAST(sum(40 + {_BYTES}) AS BIGINT) AS size_bytes, CASE WHEN min(expire_at) = 0 THEN 0 ELSE max(expire_at) END AS max_expire_at, min(seq) AS min_seq, max(seq) AS max_seq FROM log_all GROUP BY 1",
    "kv_segment_prune_key": f"{_ALL} SELECT segment, level FROM man WHERE 'user:00080:view' BETWEEN min_key AND max_key",
    "kv_segment_prune_prefix": f"{_ALL} SELECT segment, level FROM man WHERE NOT (max_key < 'user:00074:' OR (min_key > 'user:00074:' AND NOT starts_with(min_key, 'user:00074:')))",
    "kv_compaction_overlap": f"{_ALL} SELECT a.segment AS upper, b.segment AS lower FROM man a JOIN man b ON a.level = 0 AND b.level = 1 AND a.min_key <= b.max_key AND a.max_key >= b.min_key",
    "kv_compact_bottom": f"{_ALL} SELECT key, seq, value, expire_at FROM {_newest('seg')} WHERE {_IS_LIVE}",
    "kv_compact_upper": f"{_ALL} SELECT key, seq, value, expire_at FROM {_newest('(SELECT * FROM seg WHERE level = 0)')}",
    "kv_replay_from_lsn": f"{_ALL} {_LIVE}",
    "kv_wal_retention": f"""{_ALL}, f AS (SELECT seq // 1000 AS wal_id, max(seq) AS max_seq, CAST(sum(40 + {_BYTES}) AS BIGINT) AS size_bytes, max(ts) AS mtime FROM log_all GROUP BY 1)
        SELECT wal_id, max_seq, size_bytes, mtime, max_seq <= 7500 AND (1706659200 - mtime > {20 * 86400}
               OR sum(CASE WHEN max_seq <= 7500 THEN size_bytes ELSE 0 END) OVER (ORDER BY wal_id DESC) > 250000) AS deletable FROM f""",
    "kv_entry_bytes": f"{_ALL} SELECT CAST(sum(32 + {_BYTES}) AS BIGINT) AS memory_bytes, CAST(sum(40 + {_BYTES}) AS BIGINT) AS log_bytes, count(*) AS n FROM log_all",
    "kv_replication_batches": f"{_ALL} SELECT CAST((rn - 1) // 1000 AS BIGINT) AS batch, count(*) AS n, min(seq) AS min_seq, max(seq) AS max_seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM log_all) GROUP BY 1",
    "kv_follower_equals_leader": f"{_ALL} {_LIVE}",
    "kv_metrics": f"""{_ALL} SELECT count(value) AS set_count, count(*) - count(value) AS delete_count, count(*) FILTER (NOT starts_with(key, 'user:0000')) AS pruned,
        count(*) FILTER (starts_with(key, 'user:0000')) AS searched, CAST(count(*) FILTER (NOT starts_with(key, 'user:0000')) AS DOUBLE) / count(*) AS effectiveness, CAST(0 AS DOUBLE) AS idle_ratio FROM log_all""",
    "kv_span_stats": "SELECT event_type AS name, count(*) AS n, CAST(sum(us) AS BIGINT) AS total, min(us) AS least, max(us) AS greatest, avg(us) AS mean FROM (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS us FROM events) GROUP BY 1",
    "kv_scalars": f"{_ALL} SELECT key, lower(hex(encode(key))) AS hex, CAST(octet_length(encode(key)) AS INTEGER) AS size FROM snap",
    "kv_index_prefixes": f"""{_ALL}, o AS (SELECT key, row_number() OVER w AS rn, lag(key) OVER w AS before FROM snap WINDOW w AS (ORDER BY key))
        SELECT key, CASE WHEN (rn - 1) % 16 = 0 THEN 0 ELSE CAST(len(list_filter(range(1, least(length(key), length(before)) + 1), lambda i: substr(key, 1, i) = substr(before, 1, i))) AS INTEGER) END AS shared FROM o""",
    "kv_documents": "SELECT substr('doc:' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 1, 11) AS prefix, count(*) AS n, CAST(sum(32 + 13 + octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "kv_orders": "SELECT coalesce(value, '-') AS state, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY 1",
    **dict.fromkeys(
        ("kv_store_live", "kv_store_live_small", "kv_store_late", "kv_store_reopened", "kv_store_cached", "kv_store_compact_all", "kv_stream_apply", "kv_follower_late", "kv_follower_rebootstrap"),
        f"{_ALL} {_LIVE}",
    ),
    "kv_store_old_log": f"{_ALL} SELECT key, seq, value, CAST(0 AS BIGINT) AS expire_at FROM snap WHERE value IS NOT NULL",
    "kv_store_retained": f"{_ALL} SELECT key, seq, value, expire_at, {PARTS - 1} AS given_up, {PARTS - 1} AS deleted FROM live",
    "kv_follower_snapshot": f"{_ALL}{_FLUSHED} SELECT key, seq, value, expire_at, true AS required, (SELECT max(seq) FROM log) AS last_seq FROM flushed WHERE part < {PARTS - 1}",
    "kv_store_get": f"""{_ALL}, g(pos, key) AS (VALUES {_numbered(GETS)})
        SELECT pos, g.key AS key, CASE WHEN {_SHOWN} THEN value END AS value, CASE WHEN {_SHOWN} THEN expire_at END AS expire_at,
               CASE WHEN snap.key IS NULL THEN 'Key not found' WHEN value IS NULL THEN 'Key deleted' WHEN NOT ({_IS_LIVE}) THEN 'Key expired' END AS error
        FROM g LEFT JOIN snap ON snap.key = g.key""",
    "kv_store_get_expire_at": f"{_ALL} SELECT pos, req.key AS key, live.key IS NOT NULL AS exists, CAST(coalesce(expire_at, 0) AS BIGINT) AS expire_at FROM req LEFT JOIN live ON live.key = req.key",
    "kv_store_batch_get_ordered": f"{_ALL} SELECT row_number() OVER (ORDER BY pos) - 1 AS place, req.key AS key, value FROM req JOIN live ON live.key = req.key",
    "kv_store_batch_get_dedup": f"{_ALL} SELECT row_number() OVER (ORDER BY key) - 1 AS place, key, value FROM live WHERE key IN (SELECT key FROM req)",
    "kv_store_batch_get_frame": f"{_ALL} SELECT pos, req.key AS key, value FROM req JOIN live ON live.key = req.key",
    "kv_store_batch_set": f"""{_ALL}, own AS (SELECT key, seq, coalesce(value, '') AS value, expire_at FROM log_all WHERE expire_at = 0 OR expire_at > {NOW}),
        top AS (SELECT * FROM {_newest('own')})
        SELECT key, value, expire_at, (SELECT count(*) FROM log_all) AS submitted FROM (SELECT key, value, expire_at FROM top UNION ALL SELECT key, value, expire_at FROM live WHERE key NOT IN (SELECT key FROM top))""",
    "kv_store_batch_set_list": f"{_ALL}, items(pos, key, value) AS (VALUES {_ITEMS}) SELECT key, value, CAST({len(ITEMS)} AS BIGINT) AS submitted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS rn FROM items) WHERE rn = 1 AND value IS NOT NULL",
    "kv_store_set": f"""{_ALL}, own(key, value, expire_at) AS (VALUES ('{REQUESTS[0]}', 'plain', CAST(0 AS BIGINT)), ('{REQUESTS[1]}', 'timed', {NOW + 60}), ('{REQUESTS[2]}', 'at', {NOW + 5}))
        SELECT key, value, expire_at FROM own UNION ALL SELECT key, value, expire_at FROM live WHERE starts_with(key, 'user:00000:') AND key NOT IN (SELECT key FROM own)""",
    "kv_store_delete": f"""SELECT profile, key, CASE WHEN strict AND key <> 'x' THEN 'Key not found' WHEN strict AND k = 2 THEN 'Key not found' ELSE 'done' END AS answer, CAST(3 * p + k AS BIGINT) AS place
        FROM (VALUES (0, 'btree', true), (1, 'log', false), (2, 'lsm', false), (3, 'memory', true)) a(p, profile, strict), (VALUES (0, 'x'), (1, 'absent'), (2, 'x')) b(k, key)""",
    "kv_store_batch_delete": f"""{_ALL}, held AS (SELECT key FROM snap WHERE value IS NOT NULL), stop AS (SELECT min(pos) AS pos FROM req r WHERE key NOT IN (SELECT key FROM held) OR EXISTS (SELECT 1 FROM req e WHERE e.key = r.key AND e.pos < r.pos))
        SELECT 'lsm' AS profile, CAST((SELECT count(*) FROM req) AS VARCHAR) AS answer, (SELECT count(*) FROM live WHERE key NOT IN (SELECT key FROM req)) AS left_over
        UNION ALL SELECT 'btree', CAST((SELECT count(DISTINCT key) FROM req WHERE key IN (SELECT key FROM held)) AS VARCHAR), (SELECT count(*) FROM live WHERE key NOT IN (SELECT key FROM req))
        UNION ALL SELECT 'memory', CASE WHEN (SELECT pos FROM stop) IS NULL THEN CAST((SELECT count(*) FROM req) AS VARCHAR) ELSE 'Key not found' END,
                  (SELECT count(*) FROM live WHERE key NOT IN (SELECT key FROM req WHERE pos < coalesce((SELECT pos FROM stop), 1000)))""",
    "kv_store_count": f"{_ALL} SELECT prefix, count(key) AS n FROM (VALUES (''), {_PREFIXES}) p(prefix) LEFT JOIN live ON starts_with(key, prefix) GROUP BY prefix",
    "kv_store_scan": f"{_ALL} SELECT key, value, expire_at FROM live WHERE starts_with(key, 'user:0001')",
    "kv_store_cas": f"{_ALL}{_CAS} SELECT seq + (SELECT max(seq) FROM log) + 1 AS seq, key, success, current_value FROM cas",
    "kv_store_cas_single": """SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'c', true, ''), (1, 'c', false, '1'), (2, 'c', false, '1'), (3, 'c', true, '1'), (4, 'n', false, '')) t(place, key, success, current_value)""",
    "kv_store_segments": f"""{_ALL}{_FLUSHED} SELECT 0 AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS entry_count, CASE WHEN min(expire_at) = 0 THEN 0 ELSE max(expire_at) END AS max_expire_at, min(seq) AS min_seq, max(seq) AS max_seq
        FROM flushed WHERE part < {PARTS - 1} GROUP BY part""",
    "kv_store_metrics": f"""{_ALL}{_FLUSHED}, ranges AS (SELECT part, min(key) AS a, max(key) AS b FROM flushed GROUP BY part),
        asked(key) AS (VALUES {", ".join(f"('{k}')" for k in (*GETS, 'm'))}), met AS (SELECT count(*) FILTER (key BETWEEN a AND b) AS searched, count(*) AS checks FROM asked, ranges)
        SELECT CAST({len(GETS)} AS BIGINT) AS get_count, CAST(1 AS BIGINT) AS set_count, CAST(1 AS BIGINT) AS delete_count, CAST(2 AS BIGINT) AS batch_set_count, CAST(1 AS BIGINT) AS cas_count, CAST(1 AS BIGINT) AS cas_conflicts,
               CAST({PARTS} AS BIGINT) AS flush_count, CAST(1 AS BIGINT) AS compaction_count, searched, checks - searched AS pruned, round(CAST(checks - searched AS DOUBLE) / checks, 6) AS effectiveness FROM met""",
    "kv_store_expired_segment": f"{_ALL} SELECT count(*) AS n, CAST(1 AS BIGINT) AS pruned, count(*) AS after, CAST(0 AS BIGINT) AS old FROM live",
    "kv_follower_ttl": f"{_ALL} SELECT key, seq, value, expire_at FROM snap WHERE value IS NOT NULL AND (expire_at = 0 OR {LATER} <= expire_at)",
    "kv_follower_promoted": f"""{_ALL} SELECT key, value, true AS promoted FROM live WHERE starts_with(key, 'user:00000:') AND key <> '{REQUESTS[0]}' UNION ALL SELECT '{REQUESTS[0]}', 'promoted', true""",
}
