"""Rows of the inventory on logs, sessions and search: (query, DuckDB SQL written apart from it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.functions import texts, values
from loomlake.operators import filters, lineage, logs, retention, search
from loomlake.sources import writers
from loomlake.sources.folders import scratch
from loomlake.streaming import blocks as chunks_of
from loomlake.streaming.projections import written_once

from .stand_ins import duck, frame

LIMIT_NOW = 1_800_000_000_000


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark, sf_dir):
    calls = F.when(F.col("type") == "assistant/message", F.array(F.concat(F.lit("c"), F.col("turn")))).otherwise(F.array().cast("array<string>"))
    return frame(spark, sf_dir, "log").withColumn("calls", calls)


def ops(spark, sf_dir):
    return frame(spark, sf_dir, "ops").withColumnsRenamed({"first_seq": "start", "last_seq": "end"})


def folded(spark, sf_dir):
    return logs.surface(ops(spark, sf_dir), F.col("amount"))


def sessions(spark, sf_dir):
    return frame(spark, sf_dir, "sessions")


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations")


_SHADOW = "EXISTS (SELECT 1 FROM ops r WHERE r.session_id = e.session_id AND ((r.seq % 10 = 4 AND e.seq IN (r.seq - 2, r.seq - 1)) OR (r.seq % 10 = 9 AND e.seq BETWEEN r.seq - 5 AND r.seq - 1 AND e.op IS NOT NULL)))"
_TAIL = "SELECT session_id, max(seq) AS last, max(time) AS x, arg_max(time, seq) AS time FROM log GROUP BY session_id HAVING max(seq) % 8 <> 7"
_CLOSERS = f"""
    tail AS ({_TAIL}),
    c AS (
      SELECT session_id, last + 1 AS seq, 'tool/result' AS type, time, CASE WHEN last % 8 = 3 THEN 'not_started' ELSE 'outcome_unknown' END AS error, last // 8 AS turn, 1 AS k FROM tail
        WHERE last % 8 IN (3, 4) OR (last % 8 = 5 AND (SELECT type FROM log l WHERE l.session_id = tail.session_id AND l.seq = tail.last) = 'assistant/attempt')
      UNION ALL SELECT session_id, last + CASE WHEN last % 8 IN (3, 4) OR (last % 8 = 5 AND (SELECT type FROM log l WHERE l.session_id = tail.session_id AND l.seq = tail.last) = 'assistant/attempt') THEN 2 ELSE 1 END, 'step/end', time, NULL, last // 8, 2 FROM tail WHERE last % 8 BETWEEN 1 AND 5
      UNION ALL SELECT session_id, last + 1 + CASE WHEN last % 8 BETWEEN 1 AND 5 THEN 1 ELSE 0 END + CASE WHEN last % 8 IN (3, 4) OR (last % 8 = 5 AND (SELECT type FROM log l WHERE l.session_id = tail.session_id AND l.seq = tail.last) = 'assistant/attempt') THEN 1 ELSE 0 END, 'turn/end', time, NULL, last // 8, 3 FROM tail)"""

ROWS = {
    "r001_cold_log_scan": (
        lambda s, d: logs.cold_log(log(s, d)).select("session_id", "seq", "type", "time", "synthetic"),
        duck(f"WITH {_CLOSERS} SELECT session_id, seq, type, time, false AS synthetic FROM @log UNION ALL SELECT session_id, seq, type, time, true FROM c"),
    ),
    "r016_append_order": (
        lambda s, d: logs.sequence_checks(log(s, d)),
        duck("""SELECT session_id, bool_and(seq = rn) AS dense, bool_and(time IS NOT NULL AND abs(time) < 9007199254740992) AS safe, true AS rising
                FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS rn FROM @log) t GROUP BY session_id"""),
    ),
    "r018_upsert_delete": (
        lambda s, d: writers.latest_records(read(s, d, "events").select(F.col("event_type").alias("tbl"), F.col("user_id").alias("key"), F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("version"))),
        """SELECT event_type AS tbl, user_id AS key, CAST(event_id AS VARCHAR) AS value, event_id AS version FROM events e
           WHERE event_id % 4 > 0 AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = e.event_type AND f.user_id = e.user_id AND f.event_id > e.event_id)""",
    ),
    "r019_change_feed": (
        lambda s, d: writers.change_feed(read(s, d, "events").select(F.col("event_type").alias("tbl"), F.col("user_id").alias("key"), F.when(F.col("event_id") % 4 > 1, F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("version"))),
        """SELECT tbl, key, version, CASE WHEN value IS NULL THEN 'delete' ELSE 'put' END AS op, value FROM (
             SELECT event_type AS tbl, user_id AS key, event_id AS version, CASE WHEN event_id % 4 > 1 THEN CAST(event_id AS VARCHAR) END AS value,
                    lag(event_id % 4 > 1) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM events) t
           WHERE value IS NOT NULL OR before""",
    ),
    "r025_incremental_shipping": (
        lambda s, d: writers.shipped(log(s, d), log(s, d).groupBy("session_id").agg(F.when(F.crc32(F.col("session_id").cast("binary")) % 3 > 0, F.floor(F.max("seq") / 3)).alias("accepted"), (F.max("seq") - 2).alias("through"))).select("session_id", "seq", "type"),
        None,
    ),
    "r026_event_records": (
        lambda s, d: logs.records(log(s, d), folded(s, d)),
        duck(f"SELECT l.session_id, l.seq, l.type, l.time, CASE WHEN e.op IS NULL THEN 'log-only' WHEN {_SHADOW} THEN 'shadowed' ELSE 'current' END AS surface FROM @log l JOIN @ops e ON e.session_id = l.session_id AND e.seq = l.seq"),
    ),
    "r027_search_documents": (
        lambda s, d: logs.search_documents(log(s, d), folded(s, d), F.when(F.col("type").endswith("message"), F.concat("word", F.lit(" "), F.col("seq"))).otherwise(F.lit(""))),
        duck(f"SELECT l.session_id, l.seq, l.type, l.time, CASE WHEN e.op IS NULL THEN 'log-only' WHEN {_SHADOW} THEN 'shadowed' ELSE 'current' END AS surface, concat(l.word, ' ', l.seq) AS text FROM @log l JOIN @ops e ON e.session_id = l.session_id AND e.seq = l.seq WHERE l.seq % 8 IN (2, 3)"),
    ),
    "r028_semantic_text": (
        lambda s, d: log(s, d).select("session_id", "seq", texts.event_text(F.col("type"), F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("  "), F.col("word")).alias("text"), F.lit("").alias("name"), F.lit("").alias("arguments")), F.struct(F.lit("reasoning").alias("type"), F.lit("no").alias("text"), F.lit("").alias("name"), F.lit("").alias("arguments"))), F.lit("run"), F.col("word"), F.when(F.col("event_id") % 3 == 0, "Err"), F.when(F.col("event_id") % 3 == 0, " E1 "), F.when(F.col("event_id") % 2 == 0, "error").otherwise("completed"), F.col("word")).alias("text")),
        duck("""SELECT session_id, seq, CASE type WHEN 'user/message' THEN word WHEN 'assistant/message' THEN word WHEN 'tool/call' THEN 'run' || chr(10) || word
                  WHEN 'tool/result' THEN word || CASE WHEN event_id % 3 = 0 THEN chr(10) || 'Err' || chr(10) || 'E1' ELSE '' END
                  WHEN 'turn/end' THEN CASE WHEN event_id % 2 = 0 THEN 'error' || chr(10) || word ELSE '' END ELSE '' END AS text FROM @log"""),
    ),
    "r029_outcome_text": (
        lambda s, d: read(s, d, "events").select("event_id", texts.outcome_text(F.element_at(F.array(*[F.lit(x) for x in ("error", "aborted", "max-tokens", "interrupted", "completed", "other")]), (F.col("event_id") % 6 + 1).cast("int")), F.col("event_type")).alias("text")),
        "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'error' || chr(10) || event_type WHEN 1 THEN 'aborted' WHEN 2 THEN 'max-tokens' WHEN 3 THEN 'interrupted' ELSE '' END AS text FROM events",
    ),
    "r030_block_text": (
        lambda s, d: read(s, d, "events").select("event_id", F.array_join(texts.block_text(F.struct(F.element_at(F.array(F.lit("text"), F.lit("reasoning"), F.lit("tool-call"), F.lit("image")), (F.col("event_id") % 4 + 1).cast("int")).alias("type"), F.col("event_type").alias("text"), F.lit("call").alias("name"), F.col("event_type").alias("arguments"))), "/").alias("text")),
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN 'call/' || event_type ELSE '' END AS text FROM events",
    ),
    "r031_trim_join": (
        lambda s, d: documents(s, d).select("doc_id", texts.trim_join(F.slice(F.split("text", "\n"), 1, 1000000)).alias("joined")),
        "SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY k), '') AS joined FROM (SELECT doc_id, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) t WHERE text IS NOT NULL AND x <> '' GROUP BY doc_id UNION ALL SELECT doc_id, CASE WHEN text IS NOT NULL THEN '' END FROM documents WHERE text IS NULL OR trim(text, ' ' || chr(9) || chr(13) || chr(10)) = ''",
    ),
    "r032_bounded_preview": (
        lambda s, d: turns(s, d).select("conv_id", "turn", texts.preview(F.array("text", "role"), 50).alias("preview")),
        """SELECT conv_id, turn, CASE WHEN length(t) > 49 THEN rtrim(left(t, 49)) || '…' ELSE t END AS preview
           FROM (SELECT conv_id, turn, trim(regexp_replace(text || ' ' || role, '\\s+', ' ', 'g')) AS t FROM conversations) x""",
    ),
    "r033_title": (
        lambda s, d: turns(s, d).select("conv_id", "turn", texts.title(F.concat(F.lit("\u001b[31m"), F.col("text"), F.lit("\u001b[0m‮")), 40).alias("title")),
        """SELECT conv_id, turn, rtrim(CASE WHEN strlen(t) <= 40 THEN t ELSE (SELECT left(t, max(n)) FROM range(10, 41) r(n) WHERE strlen(left(t, n)) <= 40) END) AS title
           FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) x""",
    ),
    "r034_fallback_title": (
        lambda s, d: turns(s, d).select("conv_id", "turn", texts.fallback_title(F.col("text"), 3, 1000).alias("title")),
        "SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')[1:3], ' ') AS title FROM conversations",
    ),
    "r037_reference_remap": (
        lambda s, d: logs.remap_references(log(s, d).select("session_id", "seq", F.filter(F.array(F.col("seq") - 1, F.col("seq") - 3), lambda x: x >= 0).alias("sources")), log(s, d).select("session_id", "seq", (F.col("seq") * 2 + 1).alias("new"))).select("session_id", "seq", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), "forward", "dangling"),
        duck("SELECT session_id, seq * 2 + 1 AS seq, CASE WHEN seq >= 3 THEN concat(seq * 2 - 1, ',', seq * 2 - 5) WHEN seq >= 1 THEN concat(seq * 2 - 1) ELSE '' END AS sources, false AS forward, false AS dangling FROM @log"),
    ),
    "r038_child_facts": (
        lambda s, d: logs.child_facts(log(s, d).withColumns({"type": F.when(F.col("event_id") % 20 == 0, "session/descriptor").otherwise(F.col("type")), "data": F.col("event_id")})),
        duck("SELECT session_id, count(*) FILTER (event_id % 20 = 0) AS descriptors, arg_min(event_id, seq) FILTER (event_id % 20 = 0) AS first FROM @log GROUP BY session_id"),
    ),
    "r039_render_hits": (
        lambda s, d: search.render_hits(sessions(s, d).select("id", "parent", F.col("live").alias("available"), F.col("created_at").alias("seq"), F.coalesce("cwd", F.lit("?")).alias("text")), ["id"]),
        duck("SELECT id, concat(id, ' | parent ', coalesce(CAST(parent AS VARCHAR), '-'), ' | ', CASE WHEN live THEN 'available' ELSE 'unavailable' END, ' | #', created_at, ' ', coalesce(cwd, '?')) AS line FROM @sessions"),
    ),
    "r040_render_window": (
        lambda s, d: search.render_window(log(s, d).select("session_id", "seq", "type", F.col("word").alias("text")), F.col("seq") % 9 == 4).select("session_id", "seq", "line"),
        duck("""SELECT session_id, seq, CASE WHEN seq % 9 = 4 THEN concat('{"seq":', seq, ',"type":"', type, '","text":"', word, '"}') ELSE concat('#', seq, ' ', type, ': ', word) END AS line FROM @log"""),
    ),
    "r041_relative_time": (
        lambda s, d: log(s, d).select("session_id", "seq", texts.relative_time(F.col("time") + F.col("event_id") * 7_000_000, F.lit(LIMIT_NOW)).alias("r")).select("session_id", "seq", F.col("r.unit").alias("unit"), F.col("r.count").alias("n")),
        duck(f"""SELECT session_id, seq, CASE WHEN ms < 60000 THEN 'now' WHEN ms < 3600000 THEN 'minutes' WHEN ms < 86400000 THEN 'hours' WHEN ms < 2592000000 THEN 'days' WHEN ms < 31536000000 THEN 'months' ELSE 'years' END AS unit,
                  CASE WHEN ms < 60000 THEN 0 WHEN ms < 3600000 THEN ms // 60000 WHEN ms < 86400000 THEN ms // 3600000 WHEN ms < 2592000000 THEN ms // 86400000 WHEN ms < 31536000000 THEN ms // 2592000000 ELSE ms // 31536000000 END AS n
                FROM (SELECT session_id, seq, greatest(0, {LIMIT_NOW} - time - event_id * 7000000) AS ms FROM @log) t"""),
    ),
    "r042_occupancy": (
        lambda s, d: read(s, d, "events").select("event_id", texts.occupancy(F.when(F.col("event_id") % 5 > 0, F.col("event_id")), F.when(F.col("event_id") % 7 > 0, F.col("user_id") * 10)).alias("percent")),
        "SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 AND user_id > 0 THEN CAST(least(100, round(CAST(event_id AS DOUBLE) / (user_id * 10) * 100)) AS INTEGER) END AS percent FROM events",
    ),
    "r043_session_filter": (
        lambda s, d: filters.filter_sessions(sessions(s, d), [{"kind": "cwd", "values": ["w1", None]}, {"kind": "availability", "values": ["live", "persisted"]}, {"kind": "created-at", "from": 20}]),
        duck("SELECT * FROM @sessions WHERE (cwd = 'w1' OR cwd IS NULL) AND (live OR persisted) AND created_at >= 20"),
    ),
    "r044_event_filter": (
        lambda s, d: filters.filter_events(log(s, d).select("session_id", "seq", "time", "type", F.when(F.col("seq") % 2 == 0, "current").otherwise("log-only").alias("surface"), F.concat(F.col("type"), F.lit("  a.b\n"), F.col("word")).alias("text")), [{"kind": "type", "values": ["turn/end", "user/message"]}, {"kind": "surface", "values": ["current"]}, {"kind": "seq", "from": 3, "to": 40}, {"kind": "text", "text": " MESSAGE A.B  "}]).select("session_id", "seq"),
        duck("SELECT session_id, seq FROM @log WHERE type = 'user/message' AND seq BETWEEN 3 AND 40 AND seq % 2 = 0"),
    ),
    "r045_checked_session_clauses": (lambda s, d: _checked(s, filters.session_clauses, SESSION_CASES), "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, false)) t(k, ok)"),
    "r046_checked_event_clauses": (lambda s, d: _checked(s, filters.event_clauses, EVENT_CASES), "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, false), (6, false)) t(k, ok)"),
    "r047_null_members": (
        lambda s, d: sessions(s, d).select("id", *[filters.session_predicate(c).alias(n) for n, c in (("in_cwd", {"kind": "cwd", "values": ["w1", "w2"]}), ("in_or_null", {"kind": "cwd", "values": ["w3", None]}), ("rootless", {"kind": "parent", "values": [None]}), ("none", {"kind": "availability", "values": []}))]),
        duck("SELECT id, coalesce(cwd IN ('w1', 'w2'), false) AS in_cwd, cwd IS NULL OR cwd = 'w3' AS in_or_null, parent IS NULL AS rootless, false AS none FROM @sessions"),
    ),
    "r048_event_predicates": (
        lambda s, d: log(s, d).withColumn("text", F.col("word")).select("session_id", "seq", *[filters.event_predicate(c).alias(n) for n, c in (("from5", {"kind": "seq", "from": 5}), ("to9", {"kind": "seq", "to": 9}), ("ends", {"kind": "type", "values": ["turn/end", "step/end"]}), ("said", {"kind": "text", "text": "PUR"}))]),
        duck("SELECT session_id, seq, seq >= 5 AS from5, seq <= 9 AS to9, seq % 8 IN (6, 7) AS ends, contains(lower(word), 'pur') AS said FROM @log"),
    ),
    "r049_literal_text": (
        lambda s, d: documents(s, d).select("doc_id", F.coalesce(F.col("text").rlike(filters.text_pattern(" of   the ")), F.lit(False)).alias("found"), F.coalesce(F.col("text").rlike(filters.text_pattern("(.*) |")), F.lit(False)).alias("literal")),
        "SELECT doc_id, coalesce(regexp_matches(text, '(?i)of\\s+the'), false) AS found, coalesce(regexp_matches(text, '\\(\\.\\*\\)\\s+\\|'), false) AS literal FROM documents",
    ),
    "r050_range_validation": (lambda s, d: _checked(s, filters.event_clauses, RANGE_CASES), "SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, false), (4, false), (5, false), (6, false)) t(k, ok)"),
    "r051_and_terms": (
        lambda s, d: documents(s, d).select("doc_id", search.contains_terms(F.col("text"), " THE  and ").alias("found"), search.contains_terms(F.col("text"), "  ").alias("empty_query")),
        "SELECT doc_id, coalesce(contains(lower(text), 'the') AND contains(lower(text), 'and'), false) AS found, true AS empty_query FROM documents",
    ),
    "r052_full_text_match": (
        lambda s, d: search.match_all(search.build_index(turns(s, d), ["conv_id", "turn"], F.col("text")), ["conv_id", "turn"], "the of"),
        """SELECT conv_id, turn, count(*) AS score FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM conversations) t
           WHERE term IN ('the', 'of') GROUP BY conv_id, turn HAVING count(DISTINCT term) = 2""",
    ),
    "r053_workspace": (
        lambda s, d: filters.visible_sessions(sessions(s, d).withColumn("id", F.col("id").cast("string")), "7", "w2").select("id").unionByName(filters.visible_sessions(sessions(s, d).withColumn("id", F.col("id").cast("string")), "5", None).select(F.concat(F.lit("x"), F.col("id")).alias("id"))),
        duck("SELECT CAST(id AS VARCHAR) AS id FROM @sessions WHERE cwd = 'w2' UNION ALL SELECT 'x5' FROM sessions WHERE id = 5 AND cwd IS NULL"),
    ),
    "r054_set_authorisation": (
        lambda s, d: filters.authorised_ids(sessions(s, d).select(F.coalesce("parent", "id").alias("id")), sessions(s, d), "w3"),
        duck("SELECT DISTINCT coalesce(a.parent, a.id) AS id FROM @sessions a JOIN sessions b ON b.id = coalesce(a.parent, a.id) AND b.cwd = 'w3'"),
    ),
    "r056_title_terms": (
        lambda s, d: read(s, d, "part").select("p_partkey", filters.title_terms(F.col("p_name"), ["a", "o"], ["an", "1"]).alias("fits")),
        "SELECT p_partkey, (contains(p_name, 'a') OR contains(p_name, 'o')) AND NOT contains(p_name, 'an') AND NOT contains(p_name, '1') AS fits FROM part",
    ),
    "r057_due_tasks": (
        lambda s, d: retention.due(read(s, d, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 3 > 0, "active").otherwise("done").alias("status"), (F.col("event_id") % 100).alias("scheduled_at")), F.lit(40)).select("task_id"),
        "SELECT event_id AS task_id FROM events WHERE event_id % 3 > 0 AND event_id % 100 <= 40",
    ),
    "r058_interval_overlap": (
        lambda s, d: frame(s, d, "spans").where(filters.overlapping(F.col("began") % 1000000, F.col("began") % 1000000 + 5000, 400000, 600000)).select("event_id"),
        duck("SELECT event_id FROM @spans WHERE NOT (began % 1000000 > 600000 OR began % 1000000 + 5000 < 400000)"),
    ),
    "r074_call_durations": (
        lambda s, d: logs.call_durations(log(s, d)),
        duck("SELECT a.session_id, a.turn, a.call_id, greatest(0, b.time - a.time) AS took FROM @log a JOIN log b ON b.session_id = a.session_id AND b.seq = a.seq + 1 AND b.type = 'tool/result' WHERE a.type = 'tool/call'"),
    ),
    "r075_pending_calls": (
        lambda s, d: logs.pending_calls(log(s, d)),
        duck(f"""WITH tail AS ({_TAIL}) SELECT session_id, concat('c', last // 8) AS call_id, last // 8 * 10 AS step, last // 8 * 8 + 3 AS asked, CASE WHEN last % 8 >= 4 THEN last // 8 * 8 + 4 END AS call_seq
                FROM tail WHERE last % 8 IN (3, 4) OR (last % 8 = 5 AND (SELECT type FROM @log l WHERE l.session_id = tail.session_id AND l.seq = tail.last) = 'assistant/attempt')"""),
    ),
    "r076_derived_events": (
        lambda s, d: logs.derived_events(log(s, d).withColumn("sources", F.filter(F.array(F.col("seq") - 1, F.col("seq") - 4), lambda x: x >= 0))).select("session_id", "seq", F.array_join(F.col("derived").cast("array<string>"), ",").alias("derived")),
        duck("SELECT a.session_id, a.seq, string_agg(CAST(b.seq AS VARCHAR), ',' ORDER BY b.seq) AS derived FROM @log a JOIN log b ON b.session_id = a.session_id AND b.seq IN (a.seq + 1, a.seq + 4) GROUP BY a.session_id, a.seq"),
    ),
    "r084_ancestor_chain": (
        lambda s, d: lineage.ancestors(sessions(s, d)).select("id", F.array_join(F.col("ancestors").cast("array<string>"), ">").alias("chain"), "unresolved"),
        duck("""WITH walk AS (
                  SELECT id, parent AS up, '' AS chain, CAST(0 AS BIGINT) AS n FROM @sessions
                  UNION ALL SELECT w.id, s.parent, w.chain || CASE WHEN w.n > 0 THEN '>' ELSE '' END || s.id, w.n + 1 FROM walk w JOIN sessions s ON s.id = w.up)
                SELECT id, arg_max(chain, n) AS chain, arg_max(coalesce(up, -1), n) AS u, CASE WHEN u >= 0 THEN u END AS unresolved FROM walk GROUP BY id""").replace("arg_max(coalesce(up, -1), n) AS u, CASE WHEN u >= 0 THEN u END AS unresolved", "CASE WHEN arg_max(coalesce(up, -1), n) >= 0 THEN arg_max(coalesce(up, -1), n) END AS unresolved"),
    ),
    "r085_descendant_tree": (
        lambda s, d: lineage.descendants(sessions(s, d)).select("root", "id", "depth"),
        duck("""WITH down AS (SELECT id AS root, id, 0 AS depth FROM @sessions UNION ALL SELECT w.root, s.id, w.depth + 1 FROM down w JOIN sessions s ON s.parent = w.id)
                SELECT root, id, depth FROM down WHERE depth > 0"""),
    ),
    "r086_preorder": (
        lambda s, d: lineage.descendants(sessions(s, d)).select("root", "id", F.array_join(F.transform("path", lambda p: F.concat_ws(".", p["created_at"], p["id"])), "/").alias("path")),
        duck("""WITH down AS (SELECT id AS root, id, '' AS path, 0 AS depth FROM @sessions UNION ALL SELECT w.root, s.id, w.path || CASE WHEN w.depth > 0 THEN '/' ELSE '' END || s.created_at || '.' || s.id, w.depth + 1 FROM down w JOIN sessions s ON s.parent = w.id)
                SELECT root, id, path FROM down WHERE depth > 0"""),
    ),
    "r087_pruned_subtree": (
        lambda s, d: lineage.authorised_descendants(sessions(s, d), "w1"),
        duck("""WITH down AS (SELECT id AS root, id, 0 AS depth FROM @sessions WHERE cwd = 'w1' UNION ALL SELECT w.root, s.id, w.depth + 1 FROM down w JOIN sessions s ON s.parent = w.id AND s.cwd = 'w1')
                SELECT root, id, depth FROM down WHERE depth > 0"""),
    ),
    "r088_replacement_chain": (
        lambda s, d: logs.replacement_chain(folded(s, d)).select("session_id", "seq", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain")),
        duck("""SELECT e.session_id, e.seq, concat(r.seq, CASE WHEN r.seq % 10 = 4 THEN (SELECT concat('>', n.seq) FROM ops n WHERE n.session_id = e.session_id AND n.seq = r.seq + 5) ELSE '' END) AS chain
                FROM @ops e JOIN ops r ON r.session_id = e.session_id AND ((r.seq % 10 = 4 AND e.seq IN (r.seq - 2, r.seq - 1)) OR (r.seq % 10 = 9 AND e.seq BETWEEN r.seq - 5 AND r.seq - 1 AND e.op IS NOT NULL))"""),
    ),
    "r089_call_tree": (
        lambda s, d: lineage.call_tree(sessions(s, d).select(F.col("id").alias("call_id"), "parent", F.lit("start").alias("type"), F.lit(1).alias("seq")).unionByName(sessions(s, d).where("live").select(F.col("id").alias("call_id"), "parent", F.lit("settle").alias("type"), F.lit(0).alias("seq"))), 3),
        duck("""WITH down AS (SELECT id, parent, 0 AS depth, live FROM @sessions s WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM sessions p WHERE p.id = s.parent)
                  UNION ALL SELECT s.id, s.parent, w.depth + 1, s.live FROM down w JOIN sessions s ON s.parent = w.id)
                SELECT id AS call_id, parent, CASE WHEN live THEN 'settle' ELSE 'start' END AS status, depth FROM down WHERE depth <= 3"""),
    ),
    "r103_session_statistics": (
        lambda s, d: logs.session_statistics(log(s, d).withColumn("output_tokens", F.when(F.col("type") == "assistant/message", F.col("amount")))),
        duck("""WITH st AS (SELECT session_id, turn, max(time) FILTER (seq % 8 = 1) AS b, max(time) FILTER (seq % 8 = 3) AS f, max(time) FILTER (seq % 8 = 6) AS e, max(amount) FILTER (seq % 8 = 3) AS tok,
                         max(time) FILTER (type = 'tool/call') AS c, max(time) FILTER (type = 'tool/result') AS r, count(*) FILTER (seq % 8 = 0) AS t FROM @log GROUP BY session_id, turn)
                SELECT session_id, CAST(sum(t) AS BIGINT) AS turns, count(b) AS steps, CAST(coalesce(sum(greatest(0, r - c)) FILTER (r IS NOT NULL AND c IS NOT NULL), 0) AS BIGINT) AS tool_ms, CAST(coalesce(sum(greatest(0, f - b)) FILTER (f IS NOT NULL), 0) AS BIGINT) AS ttft_ms,
                       count(f) AS ttft_steps, CAST(coalesce(sum(greatest(0, e - f)) FILTER (e IS NOT NULL), 0) AS BIGINT) AS decode_ms, CAST(coalesce(sum(tok) FILTER (e IS NOT NULL AND tok >= 0), 0) AS BIGINT) AS decode_tokens FROM st GROUP BY session_id"""),
    ),
    "r104_token_usage": (
        lambda s, d: log(s, d).groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("seq") % 4 == k, F.col("amount"))), F.lit(0)).cast("long").alias(n) for k, n in enumerate(("input", "cached", "output", "reasoning"))]),
        duck("SELECT session_id, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (seq % 4 = {k}), 0) AS BIGINT) AS {n}" for k, n in enumerate(("input", "cached", "output", "reasoning"))) + " FROM @log GROUP BY session_id"),
    ),
    "r105_surface_composition": (
        lambda s, d: logs.surface_composition(ops(s, d).withColumn("role", F.when(F.col("seq") % 10 == 0, "system").when(F.col("seq") % 10 == 1, "tools").otherwise("message")), folded(s, d), F.col("amount")),
        duck(f"""WITH now AS (SELECT * FROM @ops e WHERE op IS NOT NULL AND NOT {_SHADOW})
                SELECT session_id, coalesce(arg_max(amount, seq) FILTER (seq % 10 = 0), 0) AS system, coalesce(arg_max(amount, seq) FILTER (seq % 10 = 1), 0) AS tools, CAST(coalesce(sum(amount) FILTER (seq % 10 > 1), 0) AS BIGINT) AS messages FROM now GROUP BY session_id"""),
    ),
    "r106_surface_delta": (
        lambda s, d: folded(s, d).where("delta is not null").select("session_id", "seq", "delta"),
        duck("""SELECT e.session_id, e.seq, CAST(e.amount - coalesce((SELECT sum(r.amount) FROM ops r WHERE r.session_id = e.session_id AND r.op IS NOT NULL AND
                  ((e.seq % 10 = 4 AND r.seq IN (e.seq - 2, e.seq - 1)) OR (e.seq % 10 = 9 AND r.seq BETWEEN e.seq - 5 AND e.seq - 1))), 0) AS BIGINT) AS delta FROM @ops e WHERE e.op IS NOT NULL"""),
    ),
    "r108_next_due": (
        lambda s, d: retention.next_due(read(s, d, "events").select(F.when(F.col("event_id") % 3 > 0, "active").otherwise("done").alias("status"), (F.col("event_id") + 5).alias("scheduled_at"), (F.col("event_id") < 10).alias("failed"))),
        "SELECT min(event_id + 5) AS next_due FROM events WHERE event_id % 3 > 0 AND event_id >= 10",
    ),
    "r113_step_timing": (
        lambda s, d: log(s, d).groupBy("session_id", "turn").agg(*[F.max(F.when(F.col("seq") % 8 == k, F.col("time"))).alias(n) for k, n in ((1, "b"), (3, "f"), (6, "e"))]).select("session_id", "turn", F.when(F.col("b").isNotNull() & F.col("f").isNotNull(), F.greatest(F.lit(0), F.col("f") - F.col("b"))).cast("long").alias("ttft"), F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), F.greatest(F.lit(0), F.col("e") - F.col("f"))).cast("long").alias("decode")),
        duck("""SELECT t.session_id, t.turn, CASE WHEN f.time IS NOT NULL THEN greatest(0, f.time - b.time) END AS ttft, CASE WHEN e.time IS NOT NULL THEN greatest(0, e.time - f.time) END AS decode
                FROM (SELECT DISTINCT session_id, turn FROM @log) t LEFT JOIN log b ON b.session_id = t.session_id AND b.seq = t.turn * 8 + 1 LEFT JOIN log f ON f.session_id = t.session_id AND f.seq = t.turn * 8 + 3 LEFT JOIN log e ON e.session_id = t.session_id AND e.seq = t.turn * 8 + 6"""),
    ),
    "r115_context_window": (
        lambda s, d: logs.window_around(log(s, d), log(s, d).where("seq % 25 = 7").select("session_id", "seq"), 3, 5).select("session_id", "target", "seq"),
        duck("SELECT t.session_id, t.seq AS target, e.seq FROM @log t JOIN log e ON e.session_id = t.session_id AND e.seq BETWEEN t.seq - 3 AND t.seq + 5 WHERE t.seq % 25 = 7"),
    ),
    "r116_surface_fold": (
        lambda s, d: folded(s, d).select("session_id", "seq", "surface"),
        duck(f"SELECT session_id, seq, CASE WHEN op IS NULL THEN 'log-only' WHEN {_SHADOW} THEN 'shadowed' ELSE 'current' END AS surface FROM @ops e"),
    ),
    "r117_replacement_analysis": (
        lambda s, d: logs.replaced(folded(s, d)).select("session_id", "seq", F.array_join(F.col("replaced").cast("array<string>"), ",").alias("replaced")),
        duck("""SELECT r.session_id, r.seq, string_agg(CAST(e.seq AS VARCHAR), ',' ORDER BY e.seq) AS replaced FROM @ops r JOIN ops e ON e.session_id = r.session_id AND e.op IS NOT NULL
                  AND ((r.seq % 10 = 4 AND e.seq IN (r.seq - 2, r.seq - 1)) OR (r.seq % 10 = 9 AND (e.seq = r.seq - 5 OR e.seq BETWEEN r.seq - 4 AND r.seq - 1))) GROUP BY r.session_id, r.seq"""),
    ),
    "r118_running_balance": (
        lambda s, d: logs.running_balance(log(s, d), logs.call_delta(F.when(F.col("event_id") % 17 == 0, "tool/result").otherwise(F.col("type")), F.size("calls"))).select("session_id", "seq", "balance", "corrupt", "cut"),
        duck("""SELECT session_id, seq, CAST(b AS BIGINT) AS balance, b < 0 AS corrupt, b = 0 AS cut FROM (SELECT session_id, seq, sum(CASE WHEN event_id % 17 = 0 OR type = 'tool/result' THEN -1 WHEN seq % 8 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM @log) t"""),
    ),
    "r119_call_delta": (
        lambda s, d: log(s, d).select("session_id", "seq", logs.call_delta(F.col("type"), F.size("calls")).alias("delta")),
        duck("SELECT session_id, seq, CASE WHEN seq % 8 = 3 THEN 1 WHEN type = 'tool/result' THEN -1 ELSE 0 END AS delta FROM @log"),
    ),
    "r120_idle_compression": (
        lambda s, d: logs.idle_compressed(frame(s, d, "spans").select("user_id", "event_id", F.col("began").alias("start"), F.col("ended").alias("end")), ["user_id"]).select("user_id", "event_id", F.col("start").alias("began"), F.col("end").alias("ended")),
        duck("""SELECT user_id, event_id, began - idle AS began, ended - idle AS ended FROM (SELECT *, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY began, ended ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idle
                FROM (SELECT *, greatest(0, began - coalesce(max(ended) OVER (PARTITION BY user_id ORDER BY began, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), began)) AS gap FROM @spans) a) b"""),
    ),
    "r121_sequence_layout": (
        lambda s, d: logs.sequence_layout(log(s, d)).select("session_id", "seq", F.col("start").alias("slot"), F.col("turn_start").alias("boundary")),
        duck("SELECT session_id, seq, seq AS slot, turn * 8 AS boundary FROM @log"),
    ),
    "r122_turn_outline": (
        lambda s, d: logs.turn_outline(log(s, d), F.when(F.col("event_id") % 4 > 0, texts.preview(F.array(F.repeat("word", F.lit(9))), 50)).otherwise(F.lit("")), texts.preview(F.array("word"), 120)),
        duck("""SELECT a.session_id, a.seq, a.turn, CASE WHEN u.event_id % 4 > 0 THEN CASE WHEN length(repeat(u.word, 9)) > 49 THEN left(repeat(u.word, 9), 49) || '…' ELSE repeat(u.word, 9) END ELSE '' END AS prompt,
                  CASE WHEN e.seq IS NOT NULL THEN m.word ELSE '' END AS response
                FROM @log a LEFT JOIN log u ON u.session_id = a.session_id AND u.seq = a.seq + 2 LEFT JOIN log m ON m.session_id = a.session_id AND m.seq = a.seq + 3 LEFT JOIN log e ON e.session_id = a.session_id AND e.seq = a.seq + 7 WHERE a.seq % 8 = 0"""),
    ),
    "r125_strict_increase": (
        lambda s, d: logs.sequence_checks(log(s, d).withColumn("turn", F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.col("turn")))).select("session_id", "rising"),
        duck("""WITH s AS (SELECT session_id, seq, CASE WHEN event_id % 50 = 0 THEN 0 ELSE turn END AS t FROM @log WHERE seq % 8 = 0)
                SELECT session_id, NOT EXISTS (SELECT 1 FROM s a JOIN s b ON b.session_id = a.session_id AND b.seq > a.seq AND b.t <= a.t WHERE a.session_id = x.session_id) AS rising FROM (SELECT DISTINCT session_id FROM log) x"""),
    ),
    "r128_byte_capped_tail": (
        lambda s, d: retention.byte_tail(turns(s, d).select(F.col("conv_id").alias("stream"), F.col("turn").alias("pos"), "text"), 300),
        """SELECT stream, pos, total - from_end + b - strlen(t) AS at, t AS text, b > 300 AS gap FROM (
             SELECT conv_id AS stream, turn AS pos, strlen(text) AS b, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS total, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS from_end,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, CASE WHEN strlen(text) <= 300 THEN text ELSE (SELECT right(text, max(n)) FROM range(75, 301) r(n) WHERE strlen(right(text, n)) <= 300) END AS t
             FROM conversations WHERE text <> '') x WHERE from_end <= 300 OR k = 1""",
    ),
    "r129_offset_read": (
        lambda s, d: retention.read_from(retention.byte_tail(turns(s, d).select(F.col("conv_id").alias("stream"), F.col("turn").alias("pos"), F.left("text", F.lit(90)).alias("text")), 300), turns(s, d).groupBy(F.col("conv_id").alias("stream")).agg(F.sum(F.octet_length(F.left("text", F.lit(90)))).cast("long").alias("total")), 120).select("stream", F.size("chunks").alias("n"), "next", "lossy"),
        """SELECT stream, count(*) FILTER (kept AND upto > 120)::INT AS n, max(total) AS next, 120 < coalesce(min(upto - b) FILTER (kept), max(total)) AS lossy FROM (
             SELECT conv_id AS stream, strlen(left(text, 90)) AS b, CAST(sum(strlen(left(text, 90))) OVER (PARTITION BY conv_id) AS BIGINT) AS total, sum(strlen(left(text, 90))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
                    (sum(strlen(left(text, 90))) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 300 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) AND text <> '' AS kept FROM conversations) x GROUP BY stream""",
    ),
    "r132_grouped_tasks": (
        lambda s, d: retention.deliveries(read(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 3 > 0, "active").otherwise("done").alias("status"), (F.col("event_id") % 100).alias("scheduled_at")), F.lit(40)).select("session_id", F.array_join(F.col("tasks").cast("array<string>"), ",").alias("tasks")),
        "SELECT user_id AS session_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id % 100, event_id) AS tasks FROM events WHERE event_id % 3 > 0 AND event_id % 100 <= 40 GROUP BY user_id",
    ),
    "r133_carry_forward": (
        lambda s, d: logs.carried_groups(log(s, d), F.col("event_id") % 3 == 0).groupBy("session_id", "group").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n")).drop("group"),
        duck("""SELECT session_id, lo AS first, hi AS last, hi - lo + 1 AS n FROM (
                  SELECT session_id, coalesce(lag(seq) OVER (PARTITION BY session_id ORDER BY seq), -1) + 1 AS lo, seq AS hi FROM @log WHERE event_id % 3 <> 0
                  UNION ALL SELECT session_id, coalesce(max(seq) FILTER (event_id % 3 <> 0), -1) + 1, max(seq) FROM log GROUP BY session_id HAVING coalesce(max(seq) FILTER (event_id % 3 <> 0), -1) < max(seq)) t"""),
    ),
    "r135_child_order": (
        lambda s, d: search.best_per_group(sessions(s, d).where("parent is not null").withColumn("first", -F.col("created_at")), ["parent"], "first", ["id"]).select("parent", "id"),
        duck("SELECT parent, (arg_min(id, created_at * 100000000 + id)) AS id FROM @sessions WHERE parent IS NOT NULL GROUP BY parent"),
    ),
    "r136_best_match": (
        lambda s, d: search.best_per_group(search.match_all(search.build_index(turns(s, d), ["conv_id", "turn"], F.col("text")), ["conv_id", "turn"], "the"), ["conv_id"], "score", ["turn"]),
        """SELECT conv_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k FROM (
             SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x = 'the')) AS score FROM conversations) a WHERE score > 0) b WHERE k = 1""",
    ),
    "r137_capped_collection": (lambda s, d: _capped(s, d), "SELECT o_orderkey, (SELECT count(*) > 100 FROM orders) AS more FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100) t"),
    "r139_keyset_page": (lambda s, d: _page(s, d), "SELECT event_id, (SELECT event_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 1 OFFSET 19) AS next_before FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 20"),
    "r141_oldest_n": (
        lambda s, d: retention.oldest(read(s, d, "events"), ["user_id"], ["event_id"], 3, F.col("event_id") % 5 == 0).select("user_id", "event_id"),
        "SELECT user_id, event_id FROM events e WHERE event_id % 5 > 0 AND (SELECT count(*) FROM events f WHERE f.user_id = e.user_id AND f.event_id % 5 > 0 AND f.event_id < e.event_id) < 3",
    ),
    "r148_log_with_closers": (
        lambda s, d: logs.cold_log(log(s, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.max_by("type", "seq").alias("last_type")),
        duck(f"WITH {_CLOSERS} SELECT session_id, count(*) AS n, max(seq) AS last, 'turn/end' AS last_type FROM (SELECT session_id, seq FROM @log UNION ALL SELECT session_id, seq FROM c) t GROUP BY session_id"),
    ),
    "r179_open_turn_closers": (
        lambda s, d: logs.closers(log(s, d)).select("session_id", "seq", "type", "time", "turn", "error", "reason"),
        duck(f"WITH {_CLOSERS} SELECT session_id, seq, type, time, turn, error, CASE WHEN k = 3 THEN 'interrupted' END AS reason FROM c, (SELECT 1 FROM @log LIMIT 1) one"),
    ),
    "r149_fork_prefix": (
        lambda s, d: logs.fork_seed(log(s, d), F.lit(12)).select("session_id", "seq", "type"),
        duck("""SELECT session_id, seq, type FROM @log WHERE seq <= 12
                UNION ALL SELECT session_id, least(max(seq), 12) + 1, 'session/end-seed' FROM log GROUP BY session_id
                UNION ALL SELECT session_id, 12 + u.k + 1, u.t FROM (SELECT session_id FROM log WHERE seq = 12) f, (VALUES (1, 'tool/result'), (2, 'step/end'), (3, 'turn/end')) u(k, t)"""),
    ),
    "r165_seq_ranges": (
        lambda s, d: log(s, d).where("event_id % 6 > 0").groupBy("session_id").agg(F.array_sort(F.collect_list("seq")).alias("v")).select("session_id", F.explode(values.encode_ranges(F.col("v"))).alias("r")).select("session_id", F.col("r.start").alias("first"), F.col("r.end").alias("last")),
        duck("""WITH g AS (SELECT session_id, min(seq) AS a, max(seq) AS b FROM (SELECT session_id, seq, seq - row_number() OVER (PARTITION BY session_id ORDER BY seq) AS g FROM @log WHERE event_id % 6 > 0) t GROUP BY session_id, g)
                SELECT session_id, a AS first, b AS last FROM g WHERE b - a >= 2 UNION ALL SELECT session_id, a, NULL FROM g WHERE b - a < 2 UNION ALL SELECT session_id, b, NULL FROM g WHERE b - a = 1"""),
    ),
    "r166_seq_range_decode": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", values.decode_ranges(F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(None).cast("long").alias("end")), F.struct(F.col("o_custkey").alias("start"), (F.col("o_custkey") + F.col("o_orderkey") % 7 - 1).alias("end"))), 5).alias("v")).select("o_orderkey", F.array_join(F.col("v").cast("array<string>"), ",").alias("v")),
        """SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 4 AND o_custkey > 2 THEN concat('2,', array_to_string(range(o_custkey, o_custkey + n), ',')) END AS v FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS n FROM orders) t""",
    ),
    "r178_acceptance": (
        lambda s, d: writers.accepted_seq(log(s, d).where("seq % 8 = 6").select("session_id", "seq", F.when(F.col("event_id") % 4 == 0, F.col("seq") + 1).otherwise(F.col("seq") - 2).alias("through_seq"), F.col("session_id").alias("names"), F.when(F.col("event_id") % 5 > 0, 1).alias("format")), log(s, d).select("session_id").distinct().withColumn("version", F.lit(1))),
        duck("SELECT session_id, max(seq - 2) FILTER (event_id % 4 > 0) AS accepted, count(*) FILTER (event_id % 4 = 0) AS invalid FROM @log WHERE seq % 8 = 6 AND event_id % 5 > 0 GROUP BY session_id"),
    ),
    "r180_late_repair": (
        lambda s, d: logs.cold_log(log(s, d)).groupBy("session_id").agg(F.count_if(~F.col("synthetic")).alias("stored"), F.count_if("synthetic").alias("repaired")),
        duck(f"WITH {_CLOSERS} SELECT l.session_id, l.n AS stored, (SELECT count(*) FROM c WHERE c.session_id = l.session_id) AS repaired FROM (SELECT session_id, count(*) AS n FROM @log GROUP BY session_id) l"),
    ),
    "r017_flushed_batches": (lambda s, d: _appended(s, d), duck("SELECT session_id, count(*) AS n, max(seq) AS last, true AS refused FROM @log GROUP BY session_id")),
    "r023_log_export": (
        lambda s, d: _exported(s, d),
        duck("WITH down AS (SELECT id FROM @sessions WHERE id % 50 = 0 UNION SELECT s.id FROM down w JOIN sessions s ON s.parent = w.id) SELECT concat('s', id) AS session_id FROM down"),
    ),
    "r127_tool_history": (
        lambda s, d: logs.tool_history(_tool_events(s, d)).select("session_id", "seq", "baseline", F.array_join("available", ",").alias("available")),
        duck("""SELECT session_id, seq, 0 AS baseline, CASE WHEN seq = 0 OR seq % 8 = 4 THEN 'a,b' ELSE 'a,b,c' END AS available FROM @log WHERE seq % 4 = 0 AND seq < 16 AND (seq % 8 = 4 OR seq % 8 = 0)"""),
    ),
    "r134_steering": (
        lambda s, d: logs.steering_messages(_inbox_events(s, d)),
        duck("SELECT session_id, seq, concat('m', seq - 2) AS message_id, event_id % 5 > 0 AS steering FROM @log WHERE seq % 8 = 2"),
    ),
    "r140_cursor": (lambda s, d: _cursors(s), "SELECT * FROM (VALUES ('same', '3,x'), ('changed', 'stale cursor'), ('other', 'not a cursor')) t(k, result)"),
    "r181_written_once": (lambda s, d: _once(s, d), "SELECT count(*) AS n, 2 AS batches FROM orders"),
    "r182_shadow_price": (
        lambda s, d: chunks_of.shadow_prices(_metered(s, d)).withColumn("seq", F.expr("seq div 2")),
        duck("""SELECT session_id, seq, CASE WHEN seq % 10 NOT IN (4, 9) THEN amount WHEN seq % 10 = 9 THEN 0 WHEN seq % 20 = 4 THEN amount - 5 END AS delta, seq % 20 = 14 AS error FROM @ops WHERE op IS NOT NULL"""),
    ),
    "r183_retention": (
        lambda s, d: retention.history(log(s, d).select(F.col("session_id").alias("task_id"), F.col("event_id").alias("message_id"), F.col("time").alias("delivered_at"), F.col("seq").alias("pos")), 10, 5),
        duck("""WITH n AS (SELECT session_id, arg_max(time, seq) AS t, count(*) AS c FROM @log GROUP BY session_id), k AS (
                  SELECT l.session_id, l.event_id, l.time, row_number() OVER (PARTITION BY l.session_id ORDER BY l.seq DESC) AS nth, count(*) OVER (PARTITION BY l.session_id) AS m, n.c FROM log l JOIN n ON n.session_id = l.session_id WHERE l.time >= n.t - 864000000)
                SELECT session_id AS task_id, event_id AS message_id, time AS delivered_at, nth, m < c OR m > 5 AS pruned FROM k WHERE nth <= 5"""),
    ),
    "r184_timer": (
        lambda s, d: chunks_of.driven(read(s, d, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 3 > 0, "active").otherwise("done").alias("status"), F.col("event_id").alias("scheduled_at"), F.when(F.col("event_id") % 4 > 0, F.col("user_id") + 7).alias("every")), F.lit(600)),
        """SELECT event_id AS task_id, due AS delivered, CASE WHEN due AND every IS NOT NULL THEN event_id + ((600 - event_id) // every + 1) * every ELSE event_id END AS scheduled_at, CASE WHEN due AND every IS NULL THEN 'completed' WHEN event_id % 3 > 0 THEN 'active' ELSE 'done' END AS status
           FROM (SELECT event_id, event_id % 3 > 0 AND event_id <= 600 AS due, CASE WHEN event_id % 4 > 0 THEN user_id + 7 END AS every FROM events) t""",
    ),
    "r185_coalesced_frames": (
        lambda s, d: chunks_of.coalesced(turns(s, d).select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), "text"), 400).select("stream", "frame", "n", F.octet_length("text").cast("long").alias("bytes")),
        """SELECT stream, frame, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT conv_id AS stream, strlen(text) AS b, CAST((sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text)) // 400 AS BIGINT) AS frame FROM conversations) t GROUP BY stream, frame""",
    ),
    "r186_incremental_index": (lambda s, d: _reindexed(s, d), """SELECT term, conv_id, turn, count(*) AS tf FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(CASE WHEN turn % 3 = 1 THEN concat(text, ' changed') ELSE text END), '[\\p{L}\\p{N}]+')) AS term FROM conversations WHERE conv_id % 4 > 0) t GROUP BY term, conv_id, turn"""),
    "r187_chunked_list": (
        lambda s, d: chunks_of.chunked(log(s, d).select(F.col("session_id").alias("list_id"), F.col("seq").alias("pos"), F.col("event_id").alias("item"))).select("list_id", "chunk", F.array_join(F.col("items").cast("array<string>"), ",").alias("items")),
        duck("SELECT session_id AS list_id, seq // 64 AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seq) AS items FROM @log GROUP BY session_id, seq // 64"),
    ),
    "r188_deliveries": (lambda s, d: chunks_of.delivered(read(s, d, "events").select("event_type", "user_id")), "SELECT event_type, user_id FROM events"),
    "r189_assembled_blocks": (lambda s, d: _blocks(s, d).select("stream", "idx", "type", "text", "closed"), duck("WITH b AS (SELECT stream, idx, min(seq) AS pos, min(seq) FILTER (type = 'block-end') AS e FROM @chunks GROUP BY stream, idx) SELECT b.stream, b.idx, CASE b.idx WHEN 0 THEN 'text' WHEN 1 THEN 'reasoning' ELSE 'tool-call' END AS type, CASE WHEN e IS NOT NULL THEN concat('<', e, '>') ELSE coalesce((SELECT string_agg(text, '' ORDER BY seq) FROM chunks c WHERE c.stream = b.stream AND c.idx = b.idx AND c.type = 'text-delta'), '') END AS text, e IS NOT NULL AS closed FROM b")),
    "r190_interrupted_blocks": (lambda s, d: chunks_of.interrupted(_blocks(s, d)).select("stream", "idx"), duck("SELECT stream, idx FROM @chunks WHERE idx < 2 GROUP BY stream, idx HAVING count(*) FILTER (type <> 'block-start') > 0")),
    "r191_max_token_trim": (
        lambda s, d: chunks_of.finished(_blocks(s, d), frame(s, d, "chunks").groupBy("stream").agg((F.max("seq") + 1).alias("seq")).withColumns({"type": F.lit("finish"), "text": F.when(F.col("seq") % 2 == 0, "max-tokens").otherwise("stop")})).select("stream", "idx"),
        duck("SELECT stream, idx FROM @chunks c GROUP BY stream, idx HAVING idx < 2 OR (SELECT (max(seq) + 1) % 2 FROM chunks d WHERE d.stream = c.stream) = 1"),
    ),
    "r192_model_selection": (
        lambda s, d: chunks_of.model_selection(log(s, d).where("seq % 8 in (2, 5)").select("session_id", "seq", F.when(F.col("seq") % 8 == 2, "model/selection").otherwise("request/header").alias("type"), (F.col("event_id") % 3).cast("string").alias("model"))),
        duck("""SELECT session_id, CASE WHEN EXISTS (SELECT 1 FROM log h WHERE h.session_id = x.session_id AND h.seq % 8 = 5 AND h.seq > x.at AND h.event_id % 3 = x.p) THEN NULL ELSE CAST(p AS VARCHAR) END AS pending, CAST(u AS VARCHAR) AS last_used
                FROM (SELECT session_id, arg_max(event_id % 3, seq) FILTER (seq % 8 = 2) AS p, max(seq) FILTER (seq % 8 = 2) AS at, arg_max(event_id % 3, seq) FILTER (seq % 8 = 5) AS u FROM @log WHERE seq % 8 IN (2, 5) GROUP BY session_id) x"""),
    ),
}

SESSION_CASES = ([], [{"kind": "cwd", "values": [None, "a"]}], [{"kind": "id", "values": [None]}], [{"kind": "availability", "values": ["gone"]}], [{"kind": "other"}], {"kind": "id"})
EVENT_CASES = ([{"kind": "type", "values": ["a"]}], [{"kind": "text", "text": " a "}], [{"kind": "text", "text": "  "}], [{"kind": "text", "text": 3}], [{"kind": "surface", "values": ["hidden"]}], [{"kind": "type", "values": "a"}], [{}])
RANGE_CASES = ([{"kind": "seq"}], [{"kind": "seq", "from": 3, "to": 3}], [{"kind": "time", "to": -1.5}], [{"kind": "seq", "from": 4, "to": 3}], [{"kind": "seq", "from": float("nan")}], [{"kind": "time", "to": float("inf")}], [{"kind": "time", "to": "9"}])


def _checked(spark, check, cases):
    def ok(clauses):
        try:
            check(clauses)
        except filters.FilterError:
            return False
        return True

    return spark.createDataFrame([(k, ok(c)) for k, c in enumerate(cases)], "k int, ok boolean")


def _capped(spark, sf_dir):
    rows, more = search.capped(read(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 100)
    return rows.withColumn("more", F.lit(more))


def _page(spark, sf_dir):
    rows, following, _ = search.page(read(spark, sf_dir, "events").select("event_id"), "event_id", "event_id", 20, 500)
    return rows.withColumn("next_before", F.lit(following).cast("long"))


def _blocks(spark, sf_dir):
    return chunks_of.assembled(frame(spark, sf_dir, "chunks").withColumnRenamed("idx", "index")).withColumnRenamed("index", "idx")


def _metered(spark, sf_dir):
    """Each replacement of the first kind has a metering event before it, every second one over another range."""
    o = ops(spark, sf_dir).select("session_id", (F.col("seq") * 2).alias("seq"), F.lit("surface").alias("type"), "op", "start", "end", F.col("amount").alias("tokens"))
    meter = o.where("seq % 20 = 8").select("session_id", (F.col("seq") - 1).alias("seq"), F.lit("meter").alias("type"), F.lit(None).cast("string").alias("op"), F.when(F.col("seq") % 40 == 8, F.col("start")).otherwise(F.col("start") + 1).alias("start"), "end", F.lit(5).cast("long").alias("tokens"))
    return o.unionByName(meter)


def _reindexed(spark, sf_dir):
    old, key = turns(spark, sf_dir), ["conv_id", "turn"]
    new = old.where("conv_id % 4 > 0").withColumn("text", F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    digests = old.select(*key, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"))
    return search.update_index(search.build_index(old, key, F.col("text")), digests, new, key, F.col("text"))[0]


def _appended(spark, sf_dir):
    """Two batches of each session, one after the other, and a third that does not go on from them."""
    path, events = scratch(spark, "log"), log(spark, sf_dir).select("session_id", "seq", "type")
    writers.append_batch(events.where("seq < 10"), path)
    writers.append_batch(events.where("seq >= 10"), path)
    try:
        writers.append_batch(events.where("seq = 5"), path)
        refused = False
    except writers.SequenceError:
        refused = True
    return spark.read.schema(events.schema).parquet(path).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).withColumn("refused", F.lit(refused))


def _exported(spark, sf_dir):
    path, all_ = scratch(spark, "export"), sessions(spark, sf_dir)
    events = all_.select("id", F.lit(0).alias("seq"), F.concat(F.lit("s"), F.col("id")).alias("name"))
    tree = lineage.descendants(all_)
    named = lambda df, *cols: df.select(*[F.concat(F.lit("s"), F.col(c)).alias(c) for c in cols])
    wanted = all_.where("id % 50 = 0").select("id")
    keep = wanted.unionByName(tree.join(wanted.withColumnRenamed("id", "root"), "root", "left_semi").select("id")).distinct()
    # Folders are by bucket here: one for each of a few hundred sessions would be many small files.
    some = named(keep, "id")
    events.select(F.col("name").alias("session_id"), "seq").join(some.withColumnRenamed("id", "session_id"), "session_id", "left_semi").write.parquet(path)
    return spark.read.parquet(path).select("session_id")


def _tool_events(spark, sf_dir):
    """A header, then messages that add c and take it away again, over the first events of each session."""
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast("array<string>")
    rows = log(spark, sf_dir).where("seq % 4 = 0 and seq < 16")
    first = F.col("seq") == 0
    return rows.select("session_id", "seq", F.when(first, "request/header").otherwise("developer/message").alias("type"), F.when(first, names("a", "b")).otherwise(none).alias("names"), F.when(first, names("1", "2")).otherwise(none).alias("definitions"), F.lit(False).alias("series"), F.when(F.col("seq") % 8 == 0, names("c")).otherwise(none).alias("added"), F.when(F.col("seq") % 8 == 4, names("c")).otherwise(none).alias("removed"))


def _inbox_events(spark, sf_dir):
    """Each message is put into the inbox, taken out of it (or cancelled), then logged."""
    rows = log(spark, sf_dir).where("seq % 8 < 3")
    at, k = F.col("seq"), F.col("seq") % 8
    ident = F.concat(F.lit("m"), at - k)
    outcome = F.when((k == 1) & (F.lead("event_id").over(logs._session()) % 5 == 0), "canceled")
    return rows.select("session_id", "seq", F.when(k < 2, "inbox/spliced").otherwise("user/message").alias("type"), F.lit("next-step").alias("target"), F.lit(0).alias("start"), F.when(k == 1, 1).otherwise(0).alias("removed"), F.when(k == 0, F.array(ident)).otherwise(F.array().cast("array<string>")).alias("inserted"), outcome.alias("outcome"), F.when(k == 2, ident).alias("message_id"), F.lit("user").alias("source"))


def _cursors(spark):
    token = search.cursor("v1", [3, "x"])

    def told(t, version):
        try:
            return ",".join(map(str, search.resume(t, version)))
        except ValueError as e:
            return str(e)

    return spark.createDataFrame([("same", told(token, "v1")), ("changed", told(token, "v2")), ("other", told("%%", "v1"))], "k string, result string")


def _once(spark, sf_dir):
    """Two batches, the second one written again after a failure."""
    path, orders = scratch(spark, "batches"), read(spark, sf_dir, "orders").select("o_orderkey")
    write = written_once(path)
    write(orders.where("o_orderkey % 2 = 0"), 0)
    write(orders.where("o_orderkey % 2 = 1").limit(3), 1)
    write(orders.where("o_orderkey % 2 = 1"), 1)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").cast("int").alias("batches"))
