"""Check SQL (DuckDB) for the registered queries, over the provided tables."""

from __future__ import annotations

from txtrail.functions.ids import ALPHABET
from txtrail.plans.fixtures import EPOCH_2024, SERVER

CONTEXT = (
    "substr(o_orderpriority, 1, 1) || '.' || o_orderstatus || '.' || CAST(o_custkey AS VARCHAR)"
)
TABLE_NAME = "CASE l_linestatus WHEN 'O' THEN 'line_open' ELSE 'line_fill' END"


def _image(line: str) -> str:
    return (
        "'{\"part\":' || CAST(l_partkey AS VARCHAR) || ',\"line\":' ||"
        f" CAST({line} AS VARCHAR) || '}}'"
    )


VIEWS = {
    "tx_info": f"""
        SELECT '{SERVER}:' || CAST(o_orderkey AS VARCHAR) AS gtid, {CONTEXT} AS context,
               o_orderdate AS "time", CAST(1 AS INTEGER) AS status
        FROM orders""",
    "binlog_event": f"""
        SELECT 'tpch' AS db, {TABLE_NAME} AS "table",
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS action,
               '{SERVER}:' || CAST(l_orderkey AS VARCHAR) AS gtid,
               '{{"before":' || CASE l_returnflag WHEN 'A' THEN '{{}}'
                   ELSE {_image("l_linenumber")} END
               || ',"after":' || CASE l_returnflag WHEN 'A' THEN {_image("l_linenumber")}
                   WHEN 'N' THEN {_image("l_linenumber + 1")} ELSE '{{}}' END || '}}' AS data,
               l_shipdate AS "time"
        FROM lineitem""",
    "gtid_samples": f"""
        SELECT o_orderkey AS id,
               CASE o_orderkey % 6
                 WHEN 0 THEN '{SERVER}:' || CAST(o_orderkey AS VARCHAR)
                 WHEN 1 THEN '{SERVER}:1-' || CAST(o_orderkey AS VARCHAR)
                 WHEN 2 THEN 'not-a-uuid:' || CAST(o_orderkey AS VARCHAR)
                 WHEN 3 THEN '{SERVER}:x-' || CAST(o_orderkey AS VARCHAR)
                 WHEN 4 THEN '{SERVER}:' || CAST(o_orderkey AS VARCHAR) || '-'
                 ELSE '{SERVER}' END AS gtid
        FROM orders""",
    "gtid_checked": """
        SELECT id, gtid, list_slice(parts, 2, len(parts)) AS intervals,
               regexp_full_match(parts[1],
                 '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') AND len(parts) > 1 AS shaped
        FROM (SELECT id, gtid, string_split(trim(gtid), ':') AS parts FROM gtid_samples)""",
    "gtid_result": """
        SELECT id, gtid,
               shaped AND len(list_filter(intervals, lambda i: NOT (
                 len(string_split(i, '-')) <= 2
                 AND regexp_full_match(string_split(i, '-')[-1], '[+]?[0-9]+')
                 AND TRY_CAST(string_split(i, '-')[-1] AS BIGINT) IS NOT NULL))) = 0 AS valid,
               shaped AND len(list_filter(intervals, lambda i: NOT (
                 regexp_full_match(i, '[+]?[0-9]+(-[+]?[0-9]+)?')))) = 0 AS valid_strict
        FROM gtid_checked""",
    "context_samples": f"""
        SELECT o_orderkey AS id,
               CASE o_orderkey % 4 WHEN 0 THEN {CONTEXT} WHEN 1 THEN o_orderstatus || '.a.b'
                 WHEN 2 THEN '1.a.b.' || CAST(o_custkey AS VARCHAR)
                 ELSE substr(o_orderpriority, 1, 1) || '..' END AS context
        FROM orders""",
    "user_tx": f"""
        SELECT '{SERVER}:' || CAST(user_id AS VARCHAR) AS gtid,
               '1.' || CAST(event_id AS VARCHAR) || '.' AS context, ts AS "time"
        FROM events WHERE event_type = 'signup'""",
    "user_events": f"""
        SELECT event_type AS "table", '{SERVER}:' || CAST(user_id AS VARCHAR) AS gtid,
               '{{"before":{{}},"after":' || props || '}}' AS data, ts AS event_time
        FROM events WHERE event_type <> 'signup'""",
    "event_tx": f"""
        SELECT '{SERVER}:' || CAST(event_id AS VARCHAR) AS gtid,
               '1.' || event_type || '.' AS context, ts AS "time"
        FROM events""",
    "matched": "SELECT DISTINCT gtid FROM binlog_event",
    # 58^k for k < 22, as 128-bit numbers
    "powers": """
        SELECT k, list_reduce(list_concat([1::UHUGEINT], [58::UHUGEINT FOR x IN range(k)]),
                 lambda a, b: a * b) AS p
        FROM (SELECT unnest(range(22)) AS k)""",
    "order_code": f"""
        SELECT o_orderkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4),
                 substr(h, 17, 4), substr(h, 21, 12)) AS uuid,
               repeat('1', CAST(length(regexp_extract(h, '^(00)*')) // 2 AS INTEGER))
               || ltrim(digits, '1') AS code
        FROM (SELECT o_orderkey, h, string_agg(
                substr('{ALPHABET}', CAST((n // p) % 58 AS INTEGER) + 1, 1), '' ORDER BY k DESC
              ) AS digits
              FROM (SELECT o_orderkey, h,
                      ('0x' || substr(h, 1, 16))::UBIGINT::UHUGEINT
                        * 18446744073709551616::UHUGEINT
                      + ('0x' || substr(h, 17, 16))::UBIGINT::UHUGEINT AS n
                    FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))
                   CROSS JOIN powers
              GROUP BY o_orderkey, h)""",
}

# Views a view is built on.
NEEDS = {
    "gtid_checked": ["gtid_samples"],
    "gtid_result": ["gtid_samples", "gtid_checked"],
    "order_code": ["powers"],
    "matched": ["binlog_event"],
}


def _with(views: list[str], sql: str) -> str:
    names: list[str] = []
    for view in views:
        for name in [*NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql


# intervals of the ids `gtid_runs`, and the islands they form
_GTID_RUNS = """WITH keys AS (
      SELECT o_orderkey AS k, 'server-' || CAST(greatest(0, o_custkey % 5 - 2) AS VARCHAR) AS server FROM orders
    ), runs AS (
      SELECT server, 3 * k AS lo, 3 * k AS hi FROM keys WHERE k % 4 IN (0, 2)
      UNION ALL SELECT server, 3 * k, 3 * k + k % 7 FROM keys WHERE k % 4 = 1
      UNION ALL SELECT server, 3 * k + 1, 3 * k + 2 FROM keys WHERE k % 4 = 2
    ), reached AS (
      SELECT *, max(hi) OVER (PARTITION BY server ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM (SELECT DISTINCT * FROM runs)
    ), islands AS (
      SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END)
                OVER (PARTITION BY server ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island
      FROM reached
    )
"""
_MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
_TX, _EV = ["tx_info"], ["binlog_event"]
_BOTH = [*_TX, *_EV]

_RECORD = """
    SELECT t.gtid, CAST(split_part(t.context, '.', 1) AS BIGINT) AS context_type, n_events,
           n_insert, n_update, n_delete, digest
    FROM tx_info t JOIN (
      SELECT gtid, count(*) AS n_events, count(*) FILTER (action = 0) AS n_insert,
             count(*) FILTER (action = 1) AS n_update, count(*) FILTER (action = 2) AS n_delete,
             md5(string_agg(db || '|' || "table" || '|' || CAST(action AS VARCHAR) || '|' || data,
               ';' ORDER BY db, "table", action, gtid, data)) AS digest
      FROM binlog_event GROUP BY gtid) e ON t.gtid = e.gtid"""

_OUTCOME = """
    SELECT t.gtid, t.context, CASE WHEN e.n IS NULL THEN 1 ELSE 2 END AS status,
           coalesce(e.n, 0) AS n_events
    FROM tx_info t LEFT JOIN (SELECT gtid, count(*) AS n FROM binlog_event GROUP BY gtid) e
      ON t.gtid = e.gtid"""

_RAW_IMAGE = (
    "'{{\"line\":\"' || CAST({line} AS VARCHAR) || '\",\"note\":\"\\u003c' || l_linestatus"
    " || '\\u003e \\u0026 co\",\"part\":\"' || CAST(l_partkey AS VARCHAR) || '\"}}'"
)
_RAW_EVENT = f"""
    SELECT 'tpch' AS db, {TABLE_NAME} AS "table",
           CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS action,
           '{SERVER}:' || CAST(l_orderkey AS VARCHAR) AS gtid,
           CAST(epoch(l_shipdate) AS BIGINT) AS "time",
           '{{"before":' || CASE l_returnflag WHEN 'A' THEN '{{}}'
             ELSE {_RAW_IMAGE.format(line="l_linenumber")} END
           || ',"after":' || CASE l_returnflag WHEN 'A' THEN {_RAW_IMAGE.format(line="l_linenumber")}
             WHEN 'N' THEN {_RAW_IMAGE.format(line="l_linenumber + 1")} ELSE '{{}}' END
           || '}}' AS data
    FROM lineitem"""

_TOPIC_EVENTS = f"""
    SELECT '{{"db":"' || db || '","table":"' || "table" || '","action":'
           || CAST(action AS VARCHAR) || ',"gtid":"' || gtid || '","time":'
           || CAST("time" AS VARCHAR) || ',"data":"' || base64(encode(data)) || '"}}' AS value
    FROM ({_RAW_EVENT}) WHERE "table" = 'line_open'"""

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


ORACLE = {
    "audit_records": _with(_BOTH, _RECORD),
    "audit_records_in_parts": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events, count(*) AS n_collected,
             count(*) FILTER (action = 0) AS n_insert, count(*) FILTER (action = 1) AS n_update,
             count(*) FILTER (action = 2) AS n_delete
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid GROUP BY t.gtid, t.context""",
    ),
    "audit_events_long": _with(
        _BOTH,
        """SELECT t.gtid, t.context, e.db, e."table",
             CASE e.action WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete'
               ELSE 'unknown' END AS action_name,
             json_extract_string(e.data, '$.before.part') AS before_part,
             json_extract_string(e.data, '$.after.line') AS after_line
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid""",
    ),
    "audit_summary": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events,
             count(*) FILTER (action = 0) AS n_insert, count(*) FILTER (action = 1) AS n_update,
             count(*) FILTER (action = 2) AS n_delete
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid GROUP BY t.gtid, t.context""",
    ),
    "pending_transactions": _with(
        _BOTH,
        """SELECT gtid, context, 1 AS status FROM tx_info t
           WHERE NOT EXISTS (SELECT 1 FROM binlog_event e WHERE e.gtid = t.gtid)""",
    ),
    "orphan_events": _with(
        _BOTH,
        """SELECT gtid, "table", data FROM binlog_event e WHERE NOT EXISTS (
             SELECT 1 FROM tx_info t WHERE t.gtid = e.gtid AND split_part(context, '.', 1) <> '1')
        """,
    ),
    "events_of_transactions": _with(
        _BOTH,
        """SELECT gtid, "table", action, data FROM binlog_event WHERE gtid IN (
             SELECT gtid FROM tx_info WHERE split_part(context, '.', 1) = '1')""",
    ),
    "row_event_filter": f"""
        SELECT '{SERVER}:' || CAST(l_orderkey AS VARCHAR) AS gtid, {TABLE_NAME} AS "table",
               CASE l_returnflag WHEN 'A' THEN 'insert' WHEN 'N' THEN 'update' ELSE 'delete' END
                 AS event_type
        FROM lineitem""",
    "included_tables": _with(
        _EV,
        """SELECT gtid, db, "table", action, data FROM binlog_event
           WHERE db = 'tpch' AND "table" = 'line_open'""",
    ),
    "event_lookup": _with(
        _EV,
        f"""SELECT db, "table", action, gtid, data FROM binlog_event WHERE gtid = '{SERVER}:7'""",
    ),
    "event_multi_lookup": _with(
        _EV,
        f"""SELECT db, "table", action, gtid, data FROM binlog_event
            WHERE gtid IN ({", ".join(f"'{SERVER}:{n}'" for n in (1, 2, 3, 5, 8, 13))})""",
    ),
    "predicate_args": """
        SELECT c_custkey, c_name FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)""",
    "valid_transactions": _with(["gtid_result"], "SELECT id, gtid FROM gtid_result WHERE valid"),
    "rejected_transactions": _with(
        ["gtid_result"], "SELECT id, gtid FROM gtid_result WHERE NOT valid"
    ),
    "gtid_valid": _with(["gtid_result"], "SELECT id, valid, valid_strict FROM gtid_result"),
    "gtid_parts": _with(
        ["gtid_samples"],
        """SELECT id, split_part(gtid, ':', 1) AS server,
             CASE WHEN contains(gtid, ':') THEN 1 ELSE 0 END AS n_intervals,
             CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN id WHEN 2 THEN 1 WHEN 5 THEN 0 END AS n_tx
           FROM gtid_samples""",
    ),
    "gtid_executed_set": _GTID_RUNS
    + "SELECT server, min(lo) AS lo, max(hi) AS hi FROM islands GROUP BY server, island",
    "gtid_gaps": _GTID_RUNS
    + "SELECT server, reach + 1 AS lo, lo - 1 AS hi FROM reached WHERE lo > reach + 1",
    "context_parse": _with(
        ["context_samples"],
        """SELECT id, CASE WHEN error IS NULL THEN CAST(p[1] AS BIGINT) END AS "type",
             CASE WHEN error IS NULL THEN p[2] END AS param1,
             CASE WHEN error IS NULL THEN p[3] END AS param2, error
           FROM (SELECT id, p, CASE WHEN len(p) <> 3 THEN 'CorruptedDataError'
                   WHEN TRY_CAST(p[1] AS BIGINT) IS NULL THEN 'MismatchError' END AS error
                 FROM (SELECT id, string_split(context, '.') AS p FROM context_samples))""",
    ),
    "context_format": """
        SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) || '.'
               || CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '' END || '.'
               || CASE WHEN o_orderkey % 3 > 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS context
        FROM orders""",
    "context_build": """
        SELECT o_orderkey, o_orderkey % 7 AS "type",
               CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_orderstatus ELSE '' END AS param1,
               CASE WHEN o_orderkey % 4 = 2 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS param2
        FROM orders""",
    "payload_after_part": _with(
        _EV,
        """SELECT gtid, action, json_extract_string(data, '$.after.part') AS after_part
           FROM binlog_event WHERE json_extract_string(data, '$.after.part') IS NOT NULL""",
    ),
    "payload_typed": _with(
        _EV,
        """SELECT gtid, CAST(json_extract_string(data, '$.before.line') AS BIGINT) AS before_line,
             CAST(json_extract_string(data, '$.after.part') AS BIGINT) AS after_part,
             CAST(json_extract_string(data, '$.after.line') AS BIGINT) AS after_line
           FROM binlog_event""",
    ),
    "datetime_text": f"""
        SELECT o_orderkey,
               CASE o_orderkey % 8 WHEN 0 THEN {_DAY} || ' 00:00:00.000000'
                 WHEN 1 THEN {_DAY} || ' 19:41:23.000000' WHEN 2 THEN {_DAY} || ' 19:41:23.500000'
                 WHEN 3 THEN {_DAY} || ' 19:41:23.123456'
                 WHEN 4 THEN '0001-01-01 00:00:00.000000' END AS "time",
               o_orderkey % 8 < 5 AS valid,
               CASE o_orderkey % 8
                 WHEN 5 THEN 'invalid time string: ' || {_DAY} || ' 19:41:23.'
                 WHEN 6 THEN 'invalid time string: ' || substr({_DAY}, 1, 5) || '13-01' END AS error
        FROM orders""",
    "duration_text": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_suppkey % 70 < 60 THEN
                 CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END
                 * (((l_partkey % 900) * 3600 + l_linenumber * 60 + l_suppkey % 70) * 1000000
                    + l_linenumber * 100000) END AS micros
        FROM lineitem""",
    "uuid_codec": _with(
        ["order_code"],
        """SELECT o_orderkey, code, substr(code, 1, 8) AS short, uuid, true AS bad_rejected
           FROM order_code""",
    ),
    "short_id_collisions": _with(
        ["order_code"],
        """SELECT substr(code, 1, 3) AS short_id, count(DISTINCT code) AS n_ids
           FROM order_code GROUP BY 1 HAVING count(DISTINCT code) > 1""",
    ),
    "new_ids": "SELECT o_orderkey, true AS well_formed, true AS short_ok FROM orders",
    "normalise_events": _RAW_EVENT,
    "topic_events": _TOPIC_EVENTS,
    "stream_publish": _TOPIC_EVENTS,
    "topic_transactions": f"""
        SELECT '{{"time":{EPOCH_2024},"context":"' || {CONTEXT} || '","gtid":"{SERVER}:'
               || CAST(o_orderkey AS VARCHAR) || '"}}' AS value
        FROM orders""",
    "decoded_events": _with(
        _EV,
        """SELECT db, "table", action, gtid, data, CAST(epoch("time") AS BIGINT) AS event_seconds
           FROM binlog_event""",
    ),
    "decoded_transactions": f"""
        SELECT '{SERVER}:' || CAST(o_orderkey AS VARCHAR) AS gtid, {CONTEXT} AS context,
               o_orderkey + {EPOCH_2024} AS seconds, 1 AS status
        FROM orders""",
    "quarantine": """
        SELECT CASE l_orderkey % 10 WHEN 0 THEN head || '1' WHEN 1 THEN head || '1,"data":"***"}'
                 WHEN 2 THEN head || '"insert"}' ELSE '[' || head || '1}]' END AS value
        FROM (SELECT l_orderkey, '{"db":"tpch","gtid":"' || CAST(l_orderkey AS VARCHAR)
                || '","action":' AS head FROM lineitem)
        WHERE l_orderkey % 10 < 4""",
    "latest_status": _with(
        _BOTH,
        """SELECT gtid, context, CASE WHEN EXISTS (
             SELECT 1 FROM binlog_event e WHERE e.gtid = t.gtid) THEN 2 ELSE 1 END AS status
           FROM tx_info t""",
    ),
    "pending_topk": _with(
        ["event_tx"],
        f"""SELECT gtid, context, strftime("time", {_MICROS}) AS "time" FROM event_tx
            WHERE "time" >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOURS
            QUALIFY row_number() OVER (ORDER BY "time" DESC, gtid, context) <= 1000""",
    ),
    "pending_oldest": _with(
        ["user_tx"],
        f"""SELECT gtid, context, strftime("time", {_MICROS}) AS "time" FROM user_tx
            QUALIFY row_number() OVER (PARTITION BY gtid ORDER BY "time", context) = 1""",
    ),
    "pending_min_time": _with(
        ["event_tx"],
        f"""SELECT strftime(min("time"), {_MICROS}) AS min_time FROM event_tx
            WHERE "time" >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOURS""",
    ),
    "pending_backlog": _with(
        ["event_tx"],
        """SELECT least(recent, 1000) AS selected, greatest(recent - 1000, 0) AS overflow, expired
           FROM (SELECT count(*) FILTER ("time" >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOURS)
                   AS recent,
                   count(*) FILTER ("time" < TIMESTAMP '2024-01-31' - INTERVAL 72 HOURS) AS expired
                 FROM event_tx)""",
    ),
    "reconcile_pending": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events, 2 AS status
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid
           WHERE t."time" >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY GROUP BY t.gtid, t.context""",
    ),
    "reconcile_two_notices": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events
           FROM (
             SELECT gtid, context, "time" FROM tx_info
             UNION ALL
             SELECT gtid, context || '+', "time" + INTERVAL 1 HOUR FROM tx_info
             WHERE CAST(split_part(gtid, ':', -1) AS BIGINT) % 2 <> 0) t
           JOIN binlog_event e ON t.gtid = e.gtid
           WHERE t."time" >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY
           GROUP BY t.gtid, t.context""",
    ),
    "retention_events": _with(
        _EV,
        """SELECT gtid, "table", action, data FROM binlog_event
           WHERE "time" >= TIMESTAMP '2001-11-04' - INTERVAL 30 DAY""",
    ),
    "retention_tx": _with(
        _TX,
        """SELECT gtid, context FROM tx_info
           WHERE "time" >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY""",
    ),
    "complete_by_expected_count": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid
           GROUP BY t.gtid, t.context HAVING count(*) >= 3""",
    ),
    "complete_by_quiescence": _with(
        ["user_tx", "user_events"],
        """SELECT t.gtid, t.context, e.n AS n_events FROM user_tx t JOIN (
             SELECT gtid, count(*) AS n FROM user_events GROUP BY gtid
             HAVING max(event_time) <= TIMESTAMP '2024-01-31' - INTERVAL 6 HOURS) e
             ON t.gtid = e.gtid""",
    ),
    "event_counts_by_table_action": _with(
        _EV,
        """SELECT strftime("time", '%Y%m%d') AS day, db, "table",
             CASE action WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS action,
             count(*) AS n_events
           FROM binlog_event GROUP BY ALL""",
    ),
    "event_counts": _with(
        _EV, "SELECT gtid, count(*) AS n_events FROM binlog_event GROUP BY gtid"
    ),
    "ingest_lag": """
        SELECT 'web' AS db, event_type AS "table",
               strftime(ts + to_seconds(event_id % 5000), '%Y-%m-%d %H:%M') AS minute,
               max(event_id % 5000) AS max_lag_seconds, count(*) AS n_events,
               max(event_id % 5000) > 3000 AS alert
        FROM events GROUP BY 1, 2, 3""",
    "snapshot_scan": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "append_rows": """
        SELECT CAST(c_custkey AS VARCHAR) AS uuid, c_name AS name,
               c_name || '@example.com' AS email, 1 AS status FROM customer
        UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, '', 1 FROM supplier""",
    "soft_delete": """
        SELECT CAST(c_custkey AS VARCHAR) AS uuid, c_name AS name,
               c_name || '@example.com' AS email,
               CASE WHEN c_custkey IN (1, 2, 3) OR EXISTS (SELECT 1 FROM orders
                 WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 0 ELSE 1 END AS status
        FROM customer""",
    "update_by_key": """
        SELECT CAST(c_custkey AS VARCHAR) AS uuid,
               CASE WHEN k IS NULL THEN c_name ELSE 'order ' || CAST(k AS VARCHAR) END AS name,
               CASE WHEN k IS NULL THEN c_name || '@example.com'
                 WHEN k % 2 = 0 THEN 'even@example.com' END AS email, 1 AS status
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
          ON o_custkey = c_custkey""",
    "bulk_text_load": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a' || chr(9) || 'b\\' || p_name
                 WHEN 1 THEN p_name || chr(10) || '\\t' WHEN 2 THEN p_name END AS "text",
               p_size, true AS fits
        FROM part""",
    "bulk_text_continued": """
        SELECT p_partkey, p_name || repeat(chr(10), CAST(p_partkey % 7 AS INTEGER)) || '\\' AS "text",
               p_size, true AS fits
        FROM part""",
    "stored_events": _with(
        _EV,
        """SELECT '20240301' AS day, CASE "table" WHEN 'line_open' THEN 'a' ELSE 'b' END AS batch,
             "table", action, count(*) AS n_events
           FROM binlog_event GROUP BY "table", action""",
    ),
    "stored_records": f"""
        SELECT '{SERVER}:' || CAST(o_orderkey AS VARCHAR) AS gtid, {CONTEXT} AS context,
               o_orderkey + {EPOCH_2024} AS seconds, n AS n_events
        FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1
            HAVING count(*) FILTER (l_linestatus = 'O') > 0) ON l_orderkey = o_orderkey
        WHERE substr(o_orderpriority, 1, 1) = '1' AND o_orderkey >= 600""",
    "stored_two_backfills": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid GROUP BY t.gtid, t.context""",
    ),
    "stored_late_records": _with(
        _BOTH,
        """SELECT t.gtid, t.context, count(*) AS n_events
           FROM tx_info t JOIN binlog_event e ON t.gtid = e.gtid GROUP BY t.gtid, t.context""",
    ),
    "stored_statuses": _with(
        ["matched"],
        f"""SELECT '{SERVER}:' || CAST(o_orderkey AS VARCHAR) AS gtid, {CONTEXT} AS context,
              CASE WHEN m.gtid IS NULL THEN 1 ELSE 2 END AS status,
              strftime(to_timestamp(o_orderkey + {EPOCH_2024}) AT TIME ZONE 'UTC', '%Y%m') AS month
            FROM orders LEFT JOIN matched m
              ON m.gtid = '{SERVER}:' || CAST(o_orderkey AS VARCHAR)""",
    ),
    "handler_outcomes": _with(
        _BOTH,
        """SELECT t.gtid, 0 AS part, CASE WHEN e.d > 0 THEN 'ValueError: deletion' END AS error
           FROM tx_info t JOIN (SELECT gtid, count(*) FILTER (action = 2) AS d
             FROM binlog_event GROUP BY gtid) e ON t.gtid = e.gtid""",
    ),
    "handler_failures_stored": _with(
        _BOTH,
        """SELECT t.gtid, t.context, 0 AS part, a.call_no,
             CASE WHEN e.d >= a.call_no THEN 'ValueError' END AS kind,
             CASE WHEN e.d >= a.call_no THEN 'ValueError: deletion' END AS error
           FROM tx_info t JOIN (SELECT gtid, count(*) FILTER (action = 2) AS d
             FROM binlog_event GROUP BY gtid) e ON t.gtid = e.gtid
           JOIN (VALUES (1), (2)) a(call_no) ON a.call_no = 1 OR e.d > 0""",
    ),
    "stream_publish_tx": _with(
        ["gtid_result"],
        """SELECT CASE WHEN id % 7 = 3 THEN 'undecodable' WHEN NOT valid THEN 'invalid gtid' END AS reason,
             CASE WHEN id % 7 = 3 THEN 'no notice ' || CAST(id AS VARCHAR) END AS message,
             CASE WHEN id % 7 <> 3 THEN id + 1 END AS seconds,
             CASE WHEN id % 7 <> 3 THEN 'id=' || CAST(id AS VARCHAR) END AS context,
             CASE WHEN id % 7 <> 3 THEN gtid END AS gtid
           FROM gtid_result""",
    ),
    "stream_ingest": _with(
        _EV,
        """SELECT db, "table", action, gtid, data, CAST(epoch("time") AS BIGINT) AS event_seconds
           FROM binlog_event""",
    ),
    "stored_replay_after_close": _with(_BOTH, _OUTCOME),
    "stream_audit": _with(_BOTH, _OUTCOME),
    "stream_reconcile": _with(_BOTH, _OUTCOME),
    "stream_online_state": _with(
        _BOTH,
        """SELECT gtid, context, outcome, CASE WHEN outcome = 'record' THEN n_events ELSE 0 END AS n_events
           FROM (SELECT gtid, context, n_events, unnest(CASE
                   WHEN n_events = 0 THEN ['pending', 'expired']
                   WHEN CAST(split_part(gtid, ':', -1) AS BIGINT) % 2 = 1 THEN ['record']
                   ELSE ['pending', 'record'] END) AS outcome
                 FROM (SELECT t.gtid, t.context, count(e.gtid) AS n_events
                       FROM tx_info t LEFT JOIN binlog_event e ON e.gtid = t.gtid GROUP BY t.gtid, t.context, t."time"))""",
    ),
    "stream_outer_join": _with(
        ["user_tx", "user_events"],
        f"""SELECT t.gtid, t.context, e."table", e.data,
              strftime(e.event_time, {_MICROS}) AS event_time
            FROM user_tx t LEFT JOIN user_events e ON t.gtid = e.gtid
              AND e.event_time >= t."time" - INTERVAL 6 HOURS
              AND e.event_time <= t."time" + INTERVAL 6 HOURS""",
    ),
    "stream_lag_alerts": """
        WITH checks AS (
          SELECT event_type, date_trunc('hour', ts + to_seconds(late)) + to_hours(k) AS checked, max(late) AS late
          FROM (SELECT *, CASE WHEN day(ts) % 3 = 0 THEN event_id % 5000 ELSE event_id % 100 END AS late
                FROM events), (VALUES (1), (2)) AS ends(k)
          GROUP BY 1, 2),
        streaks AS (
          SELECT *, count(*) FILTER (late > 3000) OVER (PARTITION BY event_type ORDER BY checked ROWS 2 PRECEDING) AS beyond,
            count(*) FILTER (late <= 3000) OVER (PARTITION BY event_type ORDER BY checked ROWS 1 PRECEDING) AS within
          FROM checks),
        marks AS (
          SELECT *, CASE WHEN beyond = 3 THEN 'raised' ELSE 'cleared' END AS alert
          FROM streaks WHERE beyond = 3 OR within = 2)
        SELECT 'web' AS db, event_type AS "table", strftime(checked, '%Y-%m-%d %H:%M') AS checked, alert,
          late AS max_lag_seconds
        FROM (SELECT *, lag(alert, 1, 'cleared') OVER (PARTITION BY event_type ORDER BY checked) AS before FROM marks)
        WHERE alert <> before""",
    "stream_quiescent": _with(
        ["user_events"],
        f"""SELECT gtid, strftime(min(event_time), {_MICROS}) AS first_time,
              strftime(max(event_time), {_MICROS}) AS last_time, count(*) AS n_events
            FROM (SELECT gtid, event_time, sum(opens) OVER (
                    PARTITION BY gtid ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS burst
                  FROM (SELECT gtid, event_time, CASE WHEN event_time - lag(event_time) OVER (
                          PARTITION BY gtid ORDER BY event_time) < INTERVAL 6 HOURS
                          THEN 0 ELSE 1 END AS opens FROM user_events))
            GROUP BY gtid, burst""",
    ),
}
