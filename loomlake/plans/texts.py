"""SQL of the queries, in the common dialect of ``dialect``; @name is a table."""

_NOW = "1800000000000"

TEXTS = {
    # Sources
    "r001_cold_log_scan": """
        WITH tail AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM @conversations)
        SELECT conv_id, turn, role, length(text) AS n, false AS closer FROM @conversations
        UNION ALL SELECT conv_id, turn + 1, 'turn/end', 0, true FROM tail WHERE k = 1 AND role = 'user'""",
    "r002_ranged_slice": "SELECT conv_id, turn, role, text FROM @conversations WHERE turn >= 1 AND turn < 1 + 3",
    "r003_catalog_stat": "SELECT conv_id, count(*) AS n_events, CAST(sum($BYTES(text)) AS BIGINT) AS n_bytes, max(turn) AS last_turn FROM @conversations GROUP BY conv_id",
    "r007_inverted_index": "SELECT term, conv_id, turn, count(*) AS tf FROM (SELECT conv_id, turn, $WORDS(text) AS term FROM @conversations) t WHERE term <> '' GROUP BY term, conv_id, turn",
    "r009_manifest_scan": """
        SELECT m.doc_id, m.quality, d.doc_id IS NULL AS missing, coalesce(d.n_chars, 0) AS n_chars
        FROM @labels m LEFT JOIN @documents d ON d.doc_id = m.doc_id""",
    # Sinks and change logs
    "r018_upsert_latest": """
        SELECT user_id, event_type, event_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM @events) t
        WHERE k = 1""",
    "r025_incremental_shipping": "SELECT conv_id, turn, role FROM @conversations WHERE turn > 2 AND turn <= 5",
    # Projections
    "r026_event_records": "SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'assistant') THEN 'current' ELSE 'log-only' END AS surface FROM @conversations",
    "r027_search_documents": "SELECT conv_id, turn, role, trim(text) AS text FROM @conversations WHERE length(trim(text)) > 0",
    "r032_bounded_preview": """
        SELECT conv_id, turn, CASE WHEN length(t) > 59 THEN concat(substring(t, 1, 59), '…') ELSE t END AS preview
        FROM (SELECT conv_id, turn, trim($SUB(text, '[ \\t\\n\\r]+', ' ')) AS t FROM @conversations) x""",
    "r041_relative_time": f"""
        SELECT event_id, CASE WHEN d < 60000 THEN 'now' WHEN d < 3600000 THEN 'minutes' WHEN d < 86400000 THEN 'hours'
            WHEN d < 2592000000 THEN 'days' WHEN d < 31536000000 THEN 'months' ELSE 'years' END AS unit,
          CASE WHEN d < 60000 THEN 0 WHEN d < 3600000 THEN $DIV(d, 60000) WHEN d < 86400000 THEN $DIV(d, 3600000)
            WHEN d < 2592000000 THEN $DIV(d, 86400000) WHEN d < 31536000000 THEN $DIV(d, 2592000000) ELSE $DIV(d, 31536000000) END AS n
        FROM (SELECT event_id, greatest(0, {_NOW} - $MILLIS(ts)) AS d FROM @events) x""",
    "r042_occupancy_percent": "SELECT conv_id, least(100, CAST(floor(100 * n / 5000 + 0.5) AS BIGINT)) AS percent FROM (SELECT conv_id, sum(length(text)) AS n FROM @conversations GROUP BY conv_id) t",
    # Filters
    "r047_session_predicates": "SELECT c_custkey, c_mktsegment FROM @customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_mktsegment IS NULL) AND c_nationkey >= 3 AND c_nationkey <= 17",
    "r048_event_predicates": "SELECT conv_id, turn FROM @conversations WHERE turn >= 1 AND turn <= 4 AND role IN ('user') AND length(text) > 10",
    "r049_literal_text_match": "SELECT doc_id FROM @documents WHERE $MATCHES(text, '(?i)of[ \\t\\n\\r]+the')",
    "r051_all_terms": "SELECT doc_id FROM @documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%with%'",
    "r052_full_text_match": """
        SELECT conv_id, turn FROM (SELECT conv_id, turn, $WORDS(text) AS term FROM @conversations) t
        WHERE term IN ('the', 'of') GROUP BY conv_id, turn HAVING count(DISTINCT term) = 2""",
    "r054_set_authorisation": "SELECT o_orderkey FROM @orders o WHERE EXISTS (SELECT 1 FROM @customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 7)",
    "r057_due": f"SELECT event_id FROM @events WHERE event_type <> 'none' AND $MILLIS(ts) <= {_NOW}",
    "r059_page_form": """
        SELECT doc_id, CASE WHEN n_chars < 50 THEN 'scan' WHEN n_chars < 500 THEN 'sparse' WHEN n_chars < 5000 THEN 'text' ELSE 'dense' END AS form,
          CASE WHEN n_chars < 50 THEN 1 WHEN n_chars < 500 THEN 2 WHEN n_chars < 5000 THEN 3 ELSE 4 END AS rule FROM @documents""",
    # Joins
    "r061_gold_output_outer": """
        SELECT coalesce(g.k, x.k) AS k, CASE WHEN x.k IS NULL THEN 'miss' WHEN g.k IS NULL THEN 'extra' ELSE 'both' END AS verdict
        FROM (SELECT o_orderkey AS k FROM @orders WHERE o_orderkey % 3 <> 0) g
        FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM @lineitem WHERE l_orderkey % 5 <> 0) x ON g.k = x.k""",
    "r064_pairs_within_group": "SELECT a.n_regionkey AS region, a.n_name AS left_name, b.n_name AS right_name FROM @nation a JOIN @nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "r068_expectation_join": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NO_EXPECTATION' WHEN (l.quality = 1) = (d.n_chars >= 300) THEN 'MATCH' ELSE 'MISMATCH' END AS status
        FROM @documents d LEFT JOIN @labels l ON l.doc_id = d.doc_id""",
    "r070_ordinal_pairing": """
        WITH x AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM @conversations)
        SELECT a.conv_id, a.k, a.turn AS user_turn, b.turn AS reply_turn FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.k = b.k AND a.role = 'user' AND b.role = 'assistant'""",
    "r074_call_result_pairing": """
        SELECT conv_id, turn, next_turn - turn AS wait FROM (
          SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM @conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t
        WHERE role = 'user' AND next_role = 'assistant'""",
    "r075_pending_calls": """
        SELECT u.conv_id, u.turn FROM @conversations u WHERE u.role = 'user'
        AND NOT EXISTS (SELECT 1 FROM @conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""",
    "r080_outline_merge": """
        SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(a.t, ''), b.t, '') AS title
        FROM (SELECT conv_id AS k, max(CASE WHEN turn = 0 THEN text END) AS t FROM @conversations GROUP BY conv_id) a
        FULL OUTER JOIN (SELECT conv_id AS k, max(text) AS t FROM @conversations GROUP BY conv_id) b ON a.k = b.k""",
    # Recursion
    "r084_ancestor_chain": """
        WITH RECURSIVE up(id, parent, depth) AS (
          SELECT event_id, CAST(floor(event_id / 2) AS BIGINT), 0 FROM @events WHERE event_id IN (700, 901)
          UNION ALL SELECT e.event_id, CAST(floor(e.event_id / 2) AS BIGINT), up.depth + 1 FROM up JOIN @events e ON e.event_id = up.parent AND up.parent > 0)
        SELECT id, depth FROM up""",
    "r085_descendant_tree": """
        WITH RECURSIVE down(id, depth) AS (
          SELECT event_id, 0 FROM @events WHERE event_id = 5
          UNION ALL SELECT e.event_id, down.depth + 1 FROM down JOIN @events e ON CAST(floor(e.event_id / 2) AS BIGINT) = down.id WHERE down.depth < 6)
        SELECT id, depth FROM down""",
    # Aggregations
    "r090_ratio_metric": "SELECT source, count(*) AS n, sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS long_docs, CAST(floor(10000 * sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) / nullif(count(*), 0)) AS BIGINT) AS rate FROM @documents GROUP BY source",
    "r093_cohort_counts": "SELECT lang, count(*) AS total, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN quality = 0 THEN 1 END) AS bad FROM @documents d LEFT JOIN @labels l ON l.doc_id = d.doc_id GROUP BY lang",
    "r094_verdict_histogram": "SELECT event_type, count(*) AS n FROM @events GROUP BY event_type",
    "r096_contingency": "SELECT quality, toxic, count(*) AS n FROM @labels GROUP BY quality, toxic",
    "r101_exact_decimal_sum": "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM @lineitem GROUP BY l_returnflag",
    "r102_total_equals_parts": """
        SELECT o.o_orderkey, count(l.l_orderkey) AS parts, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) > CAST(round(max(o_totalprice) * 100) AS BIGINT) AS above
        FROM @orders o JOIN @lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
    "r103_session_statistics": "SELECT conv_id, count(*) AS n_events, count(CASE WHEN role = 'user' THEN 1 END) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM @conversations GROUP BY conv_id",
    "conversation_statistics": "SELECT conv_id, count(*) AS n_events, count(CASE WHEN role = 'user' THEN 1 END) AS n_user, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_assistant, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM @conversations GROUP BY conv_id",
    "r107_upper_median": """
        SELECT source, n_chars AS median FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM @documents) t
        WHERE k = CAST(floor(n / 2) AS BIGINT) + 1""",
    "r109_first_seen": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY $SHA(text) ORDER BY source, doc_id) AS k FROM @documents) t WHERE k = 1",
    "r110_duplicates": "SELECT $SHA(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM @documents GROUP BY $SHA(text) HAVING count(*) > 1",
    "r111_content_hash": "SELECT doc_id, $SHA(text) AS raw, $SHA(replace(text, chr(13) || chr(10), chr(10))) AS lf FROM @documents",
    "r114_set_digest": "SELECT source, $SHA($JOINED(line, chr(10))) AS digest, count(*) AS n FROM (SELECT source, concat(CAST(doc_id AS VARCHAR(20)), ':', $SHA(text)) AS line FROM @documents) t GROUP BY source",
    # Ordered operators
    "r115_context_window": """
        SELECT t.conv_id, e.turn, e.role FROM (SELECT conv_id, max(turn) - 2 AS target FROM @conversations GROUP BY conv_id) t
        JOIN @conversations e ON e.conv_id = t.conv_id AND e.turn >= t.target - 1 AND e.turn <= t.target + 1""",
    "r118_running_balance": "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS balance FROM @conversations",
    "r120_idle_compression": """
        SELECT event_id, ms, CAST(sum(CASE WHEN ms - before > 3600000 THEN ms - before - 3600000 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cut
        FROM (SELECT event_id, user_id, $MILLIS(ts) AS ms, coalesce(lag($MILLIS(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), $MILLIS(ts)) AS before FROM @events) t""",
    "r121_sequence_layout": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM @conversations",
    "r122_turn_outline": """
        SELECT conv_id, max(CASE WHEN role = 'user' AND k = 1 THEN substring(text, 1, 40) END) AS prompt, max(CASE WHEN role = 'assistant' AND z = 1 THEN substring(text, 1, 40) END) AS answer
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS z FROM @conversations) t GROUP BY conv_id""",
    "r123_ordinal_in_type": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM @events",
    "r124_pair_window": "SELECT conv_id, turn, length(text) + coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS n FROM @conversations",
    "r126_dense_sequence": "SELECT conv_id, min(CASE WHEN turn = k THEN 1 ELSE 0 END) = 1 AS dense FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM @conversations) t GROUP BY conv_id",
    "r128_byte_capped_tail": "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum($BYTES(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS n FROM @conversations) t WHERE n <= 2000",
    "r129_offset_read": "SELECT conv_id, turn, start FROM (SELECT conv_id, turn, sum($BYTES(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - $BYTES(text) AS start, $BYTES(text) AS n FROM @conversations) t WHERE start + n > 500",
    "r131_head_tail_prune": "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(left(text, 80), ' ... ', right(text, 80)) ELSE text END AS pruned FROM @documents",
    "r133_carry_forward": "SELECT conv_id, turn, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS grp FROM @conversations",
    # Top-k and paging
    "r136_best_match": "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM @conversations) t WHERE k = 1",
    "r137_capped_collection": "SELECT doc_id, n_chars FROM @documents ORDER BY n_chars DESC, doc_id LIMIT 101",
    "r139_keyset_page": "SELECT event_id FROM @events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 21",
    "r143_first_two": "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM @lineitem) t WHERE k <= 2",
    # Sets
    "r144_key_union": "SELECT o_custkey AS k FROM @orders UNION SELECT c_custkey FROM @customer",
    "r145_extra_rows": "SELECT c_custkey FROM @customer c WHERE NOT EXISTS (SELECT 1 FROM @orders o WHERE o.o_custkey = c.c_custkey)",
    "r147_live_persisted": "SELECT k, max(live) = 1 AS live, max(stored) = 1 AS stored FROM (SELECT o_custkey AS k, 1 AS live, 0 AS stored FROM @orders UNION ALL SELECT c_custkey, 0, 1 FROM @customer) t GROUP BY k",
    "r149_fork_prefix": "SELECT conv_id, turn, role FROM @conversations WHERE turn <= 2 UNION ALL SELECT DISTINCT conv_id, CAST(3 AS BIGINT), 'fork' FROM @conversations",
    "r150_distinct_evidence": "SELECT DISTINCT l_partkey, l_suppkey FROM @lineitem",
    # Scalars
    "r151_strict_decimal": "SELECT event_id, CASE WHEN $MATCHES(s, '^-?(0|[1-9][0-9]*)([.][0-9]+)?$') AND length(s) <= 120 THEN $NUMBER(s) END AS v FROM (SELECT event_id, CAST(CAST(event_id * 25 AS DECIMAL(20,2)) AS VARCHAR(30)) AS s FROM @events) t",
    "r153_decimal_compare": "SELECT o_orderkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS c FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(100000 AS DECIMAL(18,2)) AS b FROM @orders) t",
    "r155_decimal_shift": "SELECT p_partkey, CAST(p_size * CAST(10000 AS DECIMAL(10,0)) AS DECIMAL(20,0)) AS shares FROM @part",
    "r158_compact_text": "SELECT doc_id, $SUB(text, '[ \\t\\n\\r]+', '') AS compact FROM @documents",
    "r162_token_estimate": "SELECT conv_id, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 8) AS BIGINT) AS tokens FROM @conversations GROUP BY conv_id",
    "r165_seq_ranges": "SELECT conv_id, min(turn) AS first, max(turn) AS last FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM @conversations WHERE turn % 4 <> 3) t GROUP BY conv_id, g",
    "r166_seq_range_decode": "SELECT conv_id, $EACH(first, last) AS turn FROM (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM @conversations GROUP BY conv_id) t",
    "r172_safe_count": "SELECT event_id, event_id >= 0 AND event_id <= 9007199254740991 AS safe FROM @events",
    # Incremental
    "r175_tail_replay": """
        SELECT a.user_id, a.n + coalesce(b.n, 0) AS n FROM (SELECT user_id, count(*) AS n FROM @events WHERE event_id <= 300 GROUP BY user_id) a
        LEFT JOIN (SELECT user_id, count(*) AS n FROM @events WHERE event_id > 300 GROUP BY user_id) b ON a.user_id = b.user_id""",
    "r178_acceptance_watermark": "SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS accepted FROM @conversations GROUP BY conv_id",
    "r183_retention": f"SELECT user_id, event_id FROM (SELECT user_id, event_id, $MILLIS(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM @events) t WHERE k <= 5 AND ms >= {_NOW} - 315360000000",
}
