"""Plain SQL that answers the registered queries, written independently of the operators."""

from __future__ import annotations

LINE = """
    (concat_ws(',', 'u' || CAST(user_id AS VARCHAR),
        CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END,
        CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END)
     || CASE WHEN event_id % 7 = 0 THEN ',extra' ELSE '' END)
"""
SPOOL = """
    CASE event_type WHEN 'signup' THEN 'sms' WHEN 'purchase' THEN 'gsm' WHEN 'error' THEN 'gprs'
                    WHEN 'view' THEN 'fax' WHEN 'click' THEN 'tmp' END
"""
LINES = f"SELECT event_id, event_type, user_id, {SPOOL} AS record_type, {LINE} AS value FROM events"
AGE = "CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(string_split(value, ',')[2] AS INTEGER) END"
DAMAGED = "len(string_split(value, ',')) <> 3"

OFFSETS = """
    SELECT event_type AS topic, CAST(user_id % 64 AS INTEGER) AS partition,
           coalesce(max(event_id) FILTER (value > 50), 0) AS offset_commit,
           max(event_id) + 1 AS offset_newest
    FROM events GROUP BY 1, 2
"""
LAGS = f"""
    SELECT topic, partition, offset_commit, offset_newest, offset_newest - offset_commit AS lag
    FROM ({OFFSETS})
"""
NATIONS = "SELECT n_name AS worker, row_number() OVER (ORDER BY n_name) - 1 AS seat, count(*) OVER () AS n FROM nation"
ROUND = f"""
    SELECT w.worker, i.topic, i.partition
    FROM (SELECT topic, partition, row_number() OVER (ORDER BY topic, partition) - 1 AS i FROM ({OFFSETS})) i
    JOIN ({NATIONS}) w ON w.seat = i.i % w.n
"""
SNAKE = f"""
    SELECT w.worker, i.topic, i.partition
    FROM (SELECT topic, partition,
                 row_number() OVER (ORDER BY lag DESC, topic, partition) - 1 AS i FROM ({LAGS})) i
    JOIN ({NATIONS}) w
      ON w.seat = CASE WHEN i.i % (2 * w.n) < w.n THEN i.i % (2 * w.n) ELSE 2 * w.n - 1 - i.i % (2 * w.n) END
"""
REALLOT = f"""
    SELECT CASE WHEN g.same OR NOT g.over THEN r.worker ELSE s.worker END AS worker,
           r.topic, r.partition, NOT (g.same OR NOT g.over) AS changed
    FROM ({ROUND}) r JOIN ({SNAKE}) s USING (topic, partition),
         (SELECT count(*) = (SELECT count(DISTINCT worker) FROM ({ROUND})) AS same,
                 max(lag) > 100 AS over FROM ({LAGS})) g
"""
SQUARES = """
    SELECT event_id, event_id % 13 <> 0 AS deal_tag,
           CASE WHEN event_id % 13 <> 0 THEN (event_id % 1000 + 1) * (user_id % 100 + 1) END AS square
    FROM events
"""
CHANGES = """
    SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000000 ELSE 0 END AS o_orderkey,
           l_partkey AS o_custkey, l_extendedprice AS o_totalprice,
           row_number() OVER (
               PARTITION BY l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000000 ELSE 0 END
               ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC, l_partkey DESC,
                        l_extendedprice DESC) AS back
    FROM lineitem WHERE l_quantity > 30
"""
WHOLE = """
    CASE event_id % 8 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN ' ' || user_id WHEN 2 THEN user_id || 'x'
        WHEN 3 THEN '' WHEN 4 THEN CAST(event_id * 1000003 + 4294967296 AS VARCHAR)
        WHEN 5 THEN '+' || user_id WHEN 6 THEN '-' || user_id ELSE '99999999999999999999' END
"""
NUMBER = """
    CASE event_id % 6 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '1e400' WHEN 2 THEN '.5'
        WHEN 3 THEN '5.' WHEN 4 THEN '1.5d' ELSE ' 2.5' END
"""
INT64 = "CASE WHEN regexp_full_match(w, '[+-]?[0-9]+') THEN coalesce(TRY_CAST(w AS BIGINT), 0) ELSE 0 END"
QUERY_PIECES = r"""
    SELECT page_id, string_split_regex(
        regexp_extract(url, '\?([^#]*)', 1) || ';seen=1+2&&bad=%zz&ref=y;only', '[&;]') AS pieces
    FROM pages
"""
QUERY_PAIRS = f"""
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position,
           url_decode(replace(CASE WHEN contains(piece, '=') THEN piece[:instr(piece, '=') - 1] ELSE piece END, '+', ' ')) AS key,
           url_decode(replace(CASE WHEN contains(piece, '=') THEN piece[instr(piece, '=') + 1:] ELSE '' END, '+', ' ')) AS value
    FROM (SELECT page_id, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM ({QUERY_PIECES}))
    WHERE piece <> '' AND NOT contains(piece, '%zz')
"""
BLOCKED = "['rm', 'mkfs', 'mkfs.ext3', 'make.ext2', 'make.ext4', 'make2fs', 'shutdown', 'reboot', 'init', 'dd', {}]"
DAY = "CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER)"

# batches of 20 messages or 100,000 seconds: p are the messages, s the batches
BATCHES = """
        WITH RECURSIVE r AS (
            SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS o,
                   CAST(floor(epoch(ts)) AS BIGINT) AS clock FROM events
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY clock, o) - 1 AS pos,
                   count(*) OVER (PARTITION BY topic, partition) AS total FROM r
        ), n AS (
            SELECT *, min(pos) OVER (PARTITION BY topic, partition ORDER BY clock
                                     RANGE BETWEEN 100000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM p
        ), s AS (
            SELECT topic, partition, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS batch, total,
                   least(19, coalesce(later, total)) AS ending
            FROM n WHERE pos = 0
            UNION ALL
            SELECT s.topic, s.partition, s.ending + 1, s.batch + 1, s.total,
                   least(s.ending + 20, coalesce(n.later, s.total))
            FROM s JOIN n ON n.topic = s.topic AND n.partition = s.partition AND n.pos = s.ending
            WHERE s.ending + 1 < s.total
        )"""

# the same for rejected lines per event type, with 3 letters or 50,000 seconds
ROLLS = BATCHES.replace("user_id % 4", "0").replace("FROM events", "FROM events WHERE event_id % 7 = 0").replace(
    "100000 FOLLOWING", "50000 FOLLOWING").replace("least(19,", "least(2,").replace("s.ending + 20,", "s.ending + 3,")

# hex digits of non-negative numbers below 2^32 and of short names, in the two binary formats
PROTOBUF_ID = """CASE WHEN {n} = 0 THEN '' ELSE '{tag}' || array_to_string(list_transform(
  list_filter(range(10), lambda k: k = 0 OR {n} // CAST(pow(128, k) AS HUGEINT) > 0),
  lambda k: printf('%02X', CAST({n} // CAST(pow(128, k) AS HUGEINT) % 128
    + CASE WHEN {n} // CAST(pow(128, k + 1) AS HUGEINT) > 0 THEN 128 ELSE 0 END AS INTEGER))), '') END"""
MSGPACK_ID = """CASE WHEN {n} < 128 THEN printf('%02X', {n}) WHEN {n} < 256 THEN 'CC' || printf('%02X', {n})
  WHEN {n} < 65536 THEN 'CD' || printf('%04X', {n}) ELSE 'CE' || printf('%08X', {n}) END"""
MSGPACK_KEY = "printf('%02X', 160 + strlen('{0}')) || hex('{0}')"

ORACLES: dict[str, str] = {
    "spool_ingest": f"""
        SELECT record_type, reject_reason, count(*) AS n_lines, CAST(sum(age) AS BIGINT) AS sum_age,
               count(*) FILTER (age = 0) AS n_zero_age
        FROM (SELECT record_type,
                     CASE WHEN record_type = 'fax' THEN 'unknown_record_type'
                          WHEN {DAMAGED} THEN 'field_count' ELSE 'ok' END AS reject_reason,
                     CASE WHEN record_type <> 'fax' AND NOT {DAMAGED} THEN {AGE} END AS age
              FROM ({LINES}) WHERE record_type <> 'tmp')
        GROUP BY 1, 2""",
    "spool_scan": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "file_route": """
        SELECT source AS file_name,
               CASE WHEN regexp_matches(source, '^src1[[:digit:]]+') THEN 'match' ELSE 'skip' END AS routed,
               count(*) AS n_files
        FROM documents GROUP BY 1, 2""",
    "spool_line_numbers": f"""
        SELECT record_type, count(*) AS n_lines, true AS dense
        FROM ({LINES}) WHERE record_type <> 'tmp' GROUP BY 1""",
    "line_provenance": r"""
        SELECT doc_id, source AS file_name, CAST(i - 1 AS INTEGER) AS line_num,
               CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS value
        FROM (SELECT doc_id, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, source,
                           CASE WHEN text = '' OR ends_with(text, chr(10))
                                THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines
                    FROM documents))""",
    "skip_manifest": f"""
        SELECT 'tmp' AS prefix, CAST(sum(strlen(value) + 1) AS BIGINT) AS n_bytes
        FROM ({LINES}) WHERE record_type = 'tmp'""",
    "stream_skip": f"""
        SELECT record_type AS prefix, CAST(sum(strlen(value) + 1) AS BIGINT) AS n_bytes
        FROM ({LINES}) WHERE record_type NOT IN ('sms', 'gsm') GROUP BY 1""",
    "strict_parse": f"""
        SELECT event_id, CASE WHEN {DAMAGED} THEN 'field_count' END AS reject_reason,
               CASE WHEN NOT {DAMAGED} THEN string_split(value, ',')[1] END AS name,
               CASE WHEN NOT {DAMAGED} THEN {AGE} END AS age,
               CASE WHEN NOT {DAMAGED} THEN string_split(value, ',')[3] END AS sex
        FROM ({LINES})""",
    "reject_summary": f"""
        SELECT event_type, CASE WHEN {DAMAGED} THEN 'field_count' ELSE 'ok' END AS reject_reason,
               count(*) AS n_lines
        FROM ({LINES}) GROUP BY 1, 2""",
    "record_dispatch": f"""
        SELECT event_id, record_type, reject_reason,
               CASE WHEN reject_reason IS NULL THEN string_split(value, ',')[1] END AS name,
               CASE WHEN reject_reason IS NULL THEN {AGE} END AS age,
               CASE WHEN reject_reason IS NULL THEN string_split(value, ',')[3] END AS sex
        FROM (SELECT *, CASE WHEN record_type IN ('fax', 'tmp') THEN 'unknown_record_type'
                             WHEN {DAMAGED} THEN 'field_count' END AS reject_reason FROM ({LINES}))""",
    "zero_default_cast": rf"""
        SELECT event_id, {INT64} AS as_int64,
               CAST((({INT64} + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS as_int32,
               CAST(CASE WHEN regexp_full_match(w, '[0-9]+') THEN coalesce(TRY_CAST(w AS UBIGINT), 0) % 256
                         ELSE 0 END AS SMALLINT) AS as_uint8,
               CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
                         AND isfinite(TRY_CAST(x AS DOUBLE)) THEN TRY_CAST(x AS DOUBLE) ELSE 0 END AS as_float64,
               event_id % 5 IN (0, 1, 4) AS as_bool
        FROM (SELECT event_id, {WHOLE} AS w, {NUMBER} AS x FROM events)""",
    "record_to_line": """
        SELECT o_orderkey, concat_ws('|', o_orderstatus, o_orderkey, o_custkey, o_orderpriority) AS line
        FROM orders""",
    "payload_roundtrip": "SELECT event_id, user_id, event_type, value FROM events",
    "binary_payloads": f"""
        SELECT event_id, user_id, value, event_type, value AS packed_value, event_id AS packed_id,
               {PROTOBUF_ID.format(tag="08", n="event_id")} || {PROTOBUF_ID.format(tag="10", n="user_id")}
               || CASE WHEN event_type = '' THEN '' ELSE '1A' || printf('%02X', strlen(event_type)) || hex(event_type) END AS protobuf_hex,
               '83' || {MSGPACK_KEY.format("event_id")} || {MSGPACK_ID.format(n="event_id")}
               || {MSGPACK_KEY.format("user_id")} || {MSGPACK_ID.format(n="user_id")}
               || {MSGPACK_KEY.format("event_type")} || printf('%02X', 160 + strlen(event_type)) || hex(event_type) AS msgpack_hex
        FROM events""",
    "payload_rejects": """
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'cut' WHEN 1 THEN 'damaged' END AS error,
               CASE WHEN event_id % 3 = 2 THEN event_type END AS event_type
        FROM events""",
    "dead_letter": f"""
        SELECT CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'send' END AS fail_class, value
        FROM ({LINES}) WHERE {DAMAGED}""",
    "roll_buckets": """
        SELECT bucket_start, count(*) AS n_rows, CAST(ceil(count(*) / 2.0) AS BIGINT) AS n_files
        FROM (SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS bucket_start FROM events) GROUP BY 1""",
    "rolled_letters": f"""{ROLLS}
        SELECT s.topic AS event_type, s.batch AS roll, count(*) AS n_letters, min(p.o) AS first_event, max(p.o) AS last_event,
               CAST(sum(length(l.value)) AS BIGINT) AS n_chars
        FROM s JOIN p ON p.topic = s.topic AND p.partition = s.partition AND p.pos BETWEEN s.start AND s.ending
        JOIN ({LINES}) AS l ON l.event_id = p.o
        GROUP BY ALL""",
    "commit_chunks": """
        SELECT chunk, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
        FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders)
        GROUP BY 1""",
    "chunk_outcomes": """
        WITH numbered AS (
          SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders),
        broken AS (SELECT chunk, min(o_orderkey) AS k FROM numbered WHERE o_orderkey % 3001 = 0 GROUP BY 1)
        SELECT o_orderkey, n.chunk,
               CASE WHEN k IS NOT NULL THEN 'rolled_back' WHEN o_totalprice > 250000 THEN 'refused' ELSE 'sent' END AS state,
               CASE WHEN k IS NOT NULL THEN 'ValueError: order ' || k WHEN o_totalprice > 250000 THEN 'too dear' END AS error
        FROM numbered AS n LEFT JOIN broken AS b ON n.chunk = b.chunk""",
    "sequence_assign": """
        SELECT c_custkey, c_acctbal, 5 + 5 * row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS seq
        FROM customer""",
    "kafka_envelope": """
        SELECT CAST(user_id AS VARCHAR) AS key, props AS value, event_type AS topic,
               CAST(user_id % 4 AS INTEGER) AS partition,
               row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset"
        FROM events""",
    "topic_partitions": """
        SELECT DISTINCT event_type AS topic, CAST(user_id % 64 AS INTEGER) AS partition FROM events""",
    "rect_generate": "SELECT event_id, event_id + 2000 AS length, event_id + 2000 AS height FROM events",
    "rect_area": """
        SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS total_area
        FROM lineitem GROUP BY 1""",
    "describe_schema": """
        SELECT i AS ordinal, name, type, true AS nullable, n AS length FROM (
            SELECT 0 AS i, 'o_orderkey' AS name, 'bigint' AS type, CAST(NULL AS INTEGER) AS n
            UNION ALL SELECT 1, 'o_custkey', 'bigint', NULL
            UNION ALL SELECT 2, 'o_orderstatus', 'string', (SELECT CAST(max(length(o_orderstatus)) AS INTEGER) FROM orders)
            UNION ALL SELECT 3, 'o_totalprice', 'double', NULL
            UNION ALL SELECT 4, 'o_orderdate', 'timestamp_ntz', NULL
            UNION ALL SELECT 5, 'o_orderpriority', 'string', (SELECT CAST(max(length(o_orderpriority)) AS INTEGER) FROM orders))""",
    "pick_columns": "SELECT o_totalprice, o_orderkey FROM orders",
    "row_difference": """
        SELECT o_orderstatus, CAST(sum(CASE o_orderstatus WHEN 'P' THEN 1 ELSE -1 END) AS BIGINT) AS surplus,
               count(DISTINCT o_custkey) AS n_rows
        FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY 1""",
    "number_normalise": """
        SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS o_totalprice, o_custkey,
               CAST(o_orderstatus = 'F' AS INTEGER) AS finished
        FROM orders""",
    "empty_to_null": """
        SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, c_mktsegment FROM customer""",
    "check_day": f"""
        SELECT o_orderkey, day,
               CASE WHEN day < 10000101 THEN false
                    ELSE coalesce(strftime(TRY_STRPTIME(CAST(day AS VARCHAR), '%Y%m%d'), '%Y%m%d')
                                  = CAST(day AS VARCHAR), false) END AS valid
        FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 20230229 WHEN 2 THEN 20241301 WHEN 3 THEN 0
                     WHEN 4 THEN {DAY} // 100 * 100 + 31 ELSE {DAY} END AS day FROM orders)""",
    "previous_day": f"""
        SELECT o_orderkey, {DAY} AS day,
               CAST(strftime(o_orderdate - INTERVAL 1 DAY, '%Y%m%d') AS INTEGER) AS previous
        FROM orders""",
    "n_days_before": """
        SELECT event_id, CAST(strftime(ts + INTERVAL 8 HOUR - to_days(CAST(event_id % 40 AS INTEGER)), '%Y%m%d')
                              AS INTEGER) AS day
        FROM events""",
    "cst_format": """
        SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d%H%M%S') AS clock,
               strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') || '000000' AS day_start
        FROM events""",
    "unix_seconds": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
    "tz_localise": """
        SELECT event_id, ts + INTERVAL 8 HOUR AS home, ts + INTERVAL 3 HOUR AS utc FROM events""",
    "interval_ints": """
        SELECT l_orderkey, l_linenumber, l_quantity,
               CAST((l_linenumber - 3.5) * 12 AS BIGINT) AS months,
               CAST((l_quantity - 20) * 900000000000 AS BIGINT) AS nanos
        FROM lineitem""",
    "url_query_params": f"SELECT page_id, CAST(position AS INTEGER) AS position, key, value FROM ({QUERY_PAIRS})",
    "url_query_values": f"""
        SELECT page_id, key, string_agg(value, '|' ORDER BY position) AS "values"
        FROM ({QUERY_PAIRS}) GROUP BY 1, 2""",
    "url_escape": """
        SELECT doc_id, CAST(length(e) AS INTEGER) AS escaped_chars, md5(e) AS escaped_md5, true AS round_trip
        FROM (SELECT doc_id, replace(url_encode(text), '%20', '+') AS e FROM documents)""",
    "split_right": r"""
        SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS leaf,
               CASE WHEN contains(url, '?') THEN regexp_extract(url, '^(.*)\?[^?]*$', 1) ELSE url END AS address,
               CASE WHEN contains(url, '?') THEN regexp_extract(url, '([^?]*)$', 1) ELSE '' END AS params
        FROM pages""",
    "kv_string": """
        SELECT o_orderkey, 'resultCode=' || o_custkey
               || CASE WHEN o_orderstatus <> 'P' THEN ',priority=' || o_orderpriority ELSE '' END
               || ',status=' || o_orderstatus AS outcome
        FROM orders""",
    "string_passthrough": """
        SELECT c_custkey, substr(c_name, 3) AS tail, rpad(c_mktsegment, 12, '*') AS padded,
               c_name || '-' || c_mktsegment AS joined, CAST(c_custkey AS VARCHAR) AS key_text
        FROM customer""",
    "token_blocklist": f"""
        SELECT doc_id, NOT list_has_any(string_split(lower(text), ' '), {BLOCKED.format("'the', 'der', 'une'")}) AS allowed
        FROM documents""",
    "line_clean_join": f"""
        SELECT doc_id, accepted, CASE WHEN accepted THEN md5(array_to_string(lines, '&&')) END AS joined_md5
        FROM (SELECT doc_id, lines,
                     len(list_filter(lines, lambda x: list_has_any(string_split(lower(x), ' '),
                         {BLOCKED.format("'der', 'une'")}))) = 0 AS accepted
              FROM (SELECT doc_id, list_filter(
                        list_transform(string_split(text, chr(10)),
                                       lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))),
                        lambda x: x <> '' AND NOT starts_with(x, '#')) AS lines
                    FROM documents))""",
    "override_expand": """
        WITH d AS (SELECT n_name AS "group", c_name AS member, c_mktsegment AS login
                   FROM customer JOIN nation ON c_nationkey = n_nationkey
                   WHERE c_mktsegment = 'MACHINERY' AND n_nationkey % 2 = 1)
        SELECT n_name AS "group", s_name AS member, CAST(n_regionkey AS VARCHAR) AS login
        FROM nation JOIN supplier ON s_nationkey = n_nationkey + 3
        WHERE NOT EXISTS (SELECT 1 FROM d WHERE d."group" = n_name)
        UNION ALL SELECT "group", member, login FROM d""",
    "cursor_delete": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "cursor_upsert": f"""
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({CHANGES}))
        UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM ({CHANGES}) WHERE back = 1""",
    "cursor_update": f"""
        SELECT o.o_orderkey, o.o_custkey, coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice
        FROM orders o LEFT JOIN (SELECT * FROM ({CHANGES}) WHERE back = 1) c ON c.o_orderkey = o.o_orderkey""",
    "rows_affected": f"""
        SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ({CHANGES}))) AS updated,
               (SELECT count(DISTINCT o_orderkey) FROM ({CHANGES})
                WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS inserted""",
    "loop_expand": "SELECT c_custkey, c_name, quarter FROM customer CROSS JOIN (VALUES (1), (2), (3), (4)) v(quarter)",
    "dml_delete": """
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
        WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)""",
    "dml_update": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey
        FROM orders""",
    "dml_insert": """
        SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
        UNION ALL SELECT c_custkey + 1000000000000, c_custkey, NULL FROM customer""",
    "last_ok_offset": """
        SELECT event_type AS topic, CAST(user_id % 64 AS INTEGER) AS partition,
               max(event_id) FILTER (value > 50) AS offset_commit
        FROM events GROUP BY 1, 2""",
    "lag_report": f"SELECT *, lag - 1 AS pending, lag > 100 AS over FROM ({LAGS})",
    "first_registrant": """
        SELECT event_type, arg_min(user_id, (ts, event_id)) AS user_id FROM events GROUP BY 1""",
    "round_robin_allot": """
        SELECT w.worker, i.topic, i.partition
        FROM (SELECT topic, partition, row_number() OVER (ORDER BY topic, partition) - 1 AS i
              FROM (SELECT DISTINCT event_type AS topic, CAST(user_id AS INTEGER) AS partition FROM events)) i
        JOIN (SELECT s_name AS worker, row_number() OVER (ORDER BY s_name) - 1 AS seat, count(*) OVER () AS n
              FROM supplier) w ON w.seat = i.i % w.n""",
    "snake_allot": SNAKE,
    "reallot_guard": REALLOT,
    "allot_diff": f"""
        SELECT *, 'added' AS change FROM (({SNAKE}) EXCEPT ALL ({ROUND}))
        UNION ALL SELECT *, 'removed' AS change FROM (({ROUND}) EXCEPT ALL ({SNAKE}))""",
    "worker_load": f"""
        SELECT worker, count(*) AS n_partitions, CAST(sum(lag) AS BIGINT) AS total_lag
        FROM ({SNAKE}) JOIN ({LAGS}) USING (topic, partition) GROUP BY 1""",
    "route_to_worker": f"""
        SELECT worker, count(*) AS n_messages, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM events JOIN ({ROUND}) ON topic = event_type AND partition = user_id % 64 GROUP BY 1""",
    "count_or_time_batch": f"""{BATCHES}
        SELECT s.topic, s.partition, s.batch, s.ending < s.total AS closed, min(p.o) AS first_offset,
               max(p.o) AS last_offset, count(*) AS n_rows
        FROM s JOIN p ON p.topic = s.topic AND p.partition = s.partition AND p.pos BETWEEN s.start AND s.ending
        GROUP BY ALL""",
    "partition_batch_deal": f"""{BATCHES}
        SELECT topic, partition, batch, min(o) AS first_offset, max(o) AS last_offset, count(*) AS n_rows,
               CASE WHEN bool_or(o % 97 = 0) THEN count(*) ELSE count(*) FILTER (o % 13 = 0) END AS n_failed
        FROM (SELECT s.topic, s.partition, s.batch, p.o FROM s JOIN p ON p.topic = s.topic
              AND p.partition = s.partition AND p.pos BETWEEN s.start AND s.ending)
        GROUP BY ALL""",
    "stream_partition_batches": """
        WITH r AS (
            SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS o,
                   (row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1) // 20 AS batch FROM events
        )
        SELECT topic, partition, batch, min(o) AS first_offset, max(o) AS last_offset, count(*) AS n_rows,
               CASE WHEN bool_or(o % 97 = 0) THEN count(*) ELSE count(*) FILTER (o % 13 = 0) END AS n_failed
        FROM r GROUP BY ALL HAVING count(*) = 20""",
    "union_modes": """
        SELECT 'union' AS mode, key FROM (SELECT c_custkey AS key FROM customer UNION SELECT s_suppkey FROM supplier)
        UNION ALL
        SELECT 'union all', key FROM (SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey FROM supplier)""",
    "sum_over_union": """
        SELECT CAST(sum(a) AS DOUBLE) AS total, count(*) AS n_rows
        FROM (SELECT CAST(c_acctbal AS DECIMAL(18,2)) AS a FROM customer
              UNION SELECT CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier)""",
    "deal_udf": SQUARES,
    "deal_native": SQUARES,
    "deal_split": """
        SELECT value > 50 AS deal_tag, count(*) AS n_messages,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM events GROUP BY 1""",
    "bind_params": """
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000""",
    "select_into": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_totalprice > (SELECT floor(avg(o_totalprice)) FROM orders WHERE o_orderstatus = 'F')""",
    "common_block": """
        SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey * 2 ELSE o_custkey END AS o_custkey,
               o_orderpriority
        FROM orders WHERE o_orderstatus = 'O'""",
    "loop_block": """
        SELECT quarter, count(c_custkey) AS n FROM (VALUES (1), (2), (3), (4)) v(quarter)
        LEFT JOIN customer ON c_nationkey % 4 + 1 = quarter GROUP BY 1""",
    "run_log": """
        SELECT 'p_copy_status' AS procedure, o_orderstatus AS in_params,
               'resultcode=' || count(*) AS out_params, 0 AS result_code, 'success' AS result_info,
               count(*) AS n_written
        FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus
        UNION ALL SELECT 'p_missing', '', NULL, -1, 'fail', NULL""",
    "cursor_block": """
        WITH l AS (
            SELECT o_custkey AS custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) * 10 AS ticket
            FROM orders WHERE o_totalprice > 200000 GROUP BY 1
        ), a AS (
            SELECT * FROM l UNION ALL
            SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) FROM customer
            WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.custkey = c_custkey)
        )
        SELECT * FROM a WHERE ticket % 7 <> 0""",
    "table_commits": """
        SELECT o_orderkey, o_custkey, CAST(CASE WHEN o_custkey % 11 = 0 THEN -p ELSE p END AS DECIMAL(18,2)) AS price
        FROM (SELECT o_orderkey, o_custkey, CAST(CASE WHEN o_orderkey % 40 BETWEEN 1 AND 10 THEN o_totalprice * 2
                     ELSE o_totalprice END AS DECIMAL(18,2)) AS p FROM orders)""",
    "running_balance": """
        WITH s AS (
            SELECT *, sum(a) OVER w AS total FROM (
                SELECT o_orderkey, o_orderpriority,
                       CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS a FROM orders)
            WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)
        ), b AS (
            SELECT *, CAST(total - least(0, min(total) OVER w) AS DECIMAL(20,2)) AS now FROM s
            WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)
        )
        SELECT o_orderkey, o_orderpriority, CAST(coalesce(lag(now) OVER w, 0) AS DECIMAL(20,2)) AS was, now
        FROM b WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)""",
    "carried_value": """
        WITH c AS (
            SELECT *, last_value(CASE WHEN o_totalprice > 300000 THEN o_orderpriority END IGNORE NULLS) OVER w AS now FROM orders
            WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)
        )
        SELECT o_orderkey, lag(now) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS was, now FROM c""",
    "call_block": """
        WITH m AS (SELECT CAST(floor(avg(o_totalprice)) AS BIGINT) AS mean FROM orders WHERE o_orderstatus = 'O')
        SELECT o_orderkey, o_totalprice, mean FROM orders, m WHERE o_orderstatus = 'O' AND o_totalprice > mean""",
    "positional_binds": """
        SELECT o_orderkey, CAST(7 AS INTEGER) AS tag, '?' AS mark FROM orders
        WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000.50 AND 250000.25
          AND o_orderdate >= DATE '1993-06-01' AND o_orderpriority <> '5-LOW'""",
    "resumed_run": """
        SELECT CAST(c_nationkey % 4 + 1 AS INTEGER) AS quarter, count(*) AS n, CAST(0 AS BIGINT) AS seen
        FROM customer GROUP BY 1""",
    "stream_single_deal": SQUARES,
    "stream_batch_deal": SQUARES,
    "stream_offset_progress": OFFSETS,
    "stream_reallot": f"SELECT worker, topic, partition FROM ({REALLOT})",
    "stream_folder": f"""
        SELECT channel, CASE WHEN {DAMAGED} THEN 'parse' ELSE 'sent' END AS outcome, CAST(sum(landings) AS BIGINT) AS n_lines,
               CAST(sum(CASE WHEN NOT {DAMAGED} THEN landings * {AGE} END) AS BIGINT) AS sum_age
        FROM ({LINES}) JOIN (VALUES ('sms', 'sms', 2), ('gsm', 'gsm', 2), ('mobile', 'sms', 2), ('mobile', 'gsm', 2),
                                    ('gprs', 'gprs', 1)) v(channel, record_type, landings) USING (record_type)
        GROUP BY 1, 2""",
    "balanced_slices": """
        SELECT CAST(16 AS BIGINT) AS n_slices, count(*) AS n_read, count(*) AS n_reached, true AS even FROM lineitem""",
    "stream_ingest": f"""
        SELECT record_type, CASE WHEN {DAMAGED} THEN 'parse' ELSE 'sent' END AS outcome, count(*) AS n_lines,
               CAST(sum(CASE WHEN NOT {DAMAGED} THEN {AGE} END) AS BIGINT) AS sum_age
        FROM ({LINES}) WHERE record_type IN ('sms', 'gsm', 'gprs') GROUP BY 1, 2""",
}
