"""Rows of the inventory on facts, scores, rules, pages, values and stored state: (query, DuckDB SQL)."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomlake.functions import decimals, texts, values
from loomlake.operators import envelopes, evidence, logs, retention, rules, scoring, search, tables
from loomlake.sources import readers, writers
from loomlake.sources.folders import scratch
from loomlake.streaming import projections

from .stand_ins import duck, frame

KEY = ["case_id", "event_id"]


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(s, d):
    return frame(s, d, "gold")


def output(s, d):
    return frame(s, d, "output")


def numbers(s, d):
    return frame(s, d, "numbers")


_NUM = "regexp_full_match(trim(s), '-?(0|[1-9][0-9]*)(\\.[0-9]+)?')"
_DEC = f"CASE WHEN {_NUM} THEN CAST(trim(s) AS DECIMAL(24,8)) END"
_PLAIN = lambda x: f"CASE WHEN contains(CAST({x} AS VARCHAR), '.') THEN regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '0+$', ''), '\\.$', '') ELSE CAST({x} AS VARCHAR) END"
_HAS = lambda a: f"({a}.status = 'extracted' OR ({a}.status = 'needs_review' AND {a}.value IS NOT NULL))"


def kinds(s, d):
    """Measures of each kind, status and unit, right and wrong ones."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (n % len(v) + 1).cast("int"))
    df = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"))
    kind = pick(k, "amount", "shares", "ratio")
    unit = F.when(kind == "ratio", "%").when(kind == "shares", pick(p, "股", "万股", "亿股", "元")).otherwise(pick(p, "元", "万元", "亿元", "股"))
    status = pick(p, "present", "present", "explicit_zero", "not_mentioned")
    raw = F.when(p % 6 == 0, "0").when(p % 6 == 1, F.concat(p, F.lit(".25"))).when(p % 6 == 2, "1e5").otherwise(p.cast("string"))
    raw = F.when((status == "not_mentioned") & (k % 5 > 0), F.lit(None)).otherwise(raw)
    none = F.lit(None).cast("string")
    u, q = F.when(raw.isNull(), none).otherwise(unit), F.when(raw.isNull(), none).otherwise(pick(k, "exact", "approx"))
    den = F.when((kind == "ratio") & (status != "not_mentioned") & (k % 7 > 0), "net_assets")
    return df.select("l_orderkey", kind.alias("kind"), status.alias("status"), raw.alias("raw"), u.alias("unit"), q.alias("qualifier"), den.alias("den"))


_MEASURES = """
    m0 AS (SELECT l_orderkey, min(l_partkey) AS p, l_orderkey AS k FROM lineitem GROUP BY l_orderkey),
    m1 AS (SELECT *, ['amount', 'shares', 'ratio'][CAST(k % 3 + 1 AS INT)] AS kind, ['present', 'present', 'explicit_zero', 'not_mentioned'][CAST(p % 4 + 1 AS INT)] AS status,
             CASE WHEN p % 6 = 0 THEN '0' WHEN p % 6 = 1 THEN concat(p, '.25') WHEN p % 6 = 2 THEN '1e5' ELSE CAST(p AS VARCHAR) END AS raw0 FROM m0),
    m2 AS (SELECT *, CASE WHEN status = 'not_mentioned' AND k % 5 > 0 THEN NULL ELSE raw0 END AS raw,
             CASE kind WHEN 'ratio' THEN 0 WHEN 'shares' THEN [0, 4, 8, NULL][CAST(p % 4 + 1 AS INT)] ELSE [0, 4, 8, NULL][CAST(p % 4 + 1 AS INT)] END AS places,
             kind = 'ratio' AND status <> 'not_mentioned' AS needs, kind = 'ratio' AND status <> 'not_mentioned' AND k % 7 > 0 AS has, k % 2 = 0 AS exact FROM m1),
    m3 AS (SELECT *, CASE WHEN regexp_full_match(raw, '[0-9]+(\\.[0-9]+)?') AND places IS NOT NULL THEN CAST(raw AS DECIMAL(24,2)) * CAST(CAST(pow(10, places) AS BIGINT) AS DECIMAL(12,0)) END AS v FROM m2),
    m4 AS (SELECT *, CASE WHEN needs AND NOT has THEN 'denominator_required' WHEN status = 'not_mentioned' AND raw IS NOT NULL THEN 'missing_with_number'
             WHEN status <> 'not_mentioned' AND (raw = '1e5' OR places IS NULL) THEN 'invalid_number' WHEN status <> 'not_mentioned' AND kind = 'shares' AND v <> floor(v) THEN 'not_whole_shares'
             WHEN status = 'explicit_zero' AND (v <> 0 OR NOT exact) THEN 'zero_not_stated' WHEN status = 'present' AND v = 0 AND exact THEN 'zero_not_declared' END AS error FROM m3)"""

SCHEMA = {"type": "object", "required": ["id", "kind"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 10}, "kind": {"enum": ["view", "click", "purchase"]}, "note": {"$ref": "#/$defs/note"}}, "$defs": {"note": {"anyOf": [{"type": "null"}, {"type": "string", "minLength": 2, "pattern": "^[a-z]"}]}}}

ROWS = {
    "r004_generation": (
        lambda s, d: readers.newest_generation(_log_names(s, d)),
        """SELECT session_id, concat('session', CASE WHEN g > 0 THEN concat('.v', g) ELSE '' END, '.jsonl') AS name, CAST(g AS INTEGER) AS generation FROM (SELECT user_id AS session_id, max(event_id % 5) FILTER (event_id % 3 > 0) AS g FROM events GROUP BY user_id) t WHERE g IS NOT NULL""",
    ),
    "r009_manifest_scan": (
        lambda s, d: readers.by_manifest(read(s, d, "documents").select("doc_id"), read(s, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "bad").alias("corrupt")), read(s, d, "documents").where("doc_id % 4 > 0").select("doc_id"), "doc_id"),
        """SELECT d.doc_id, CASE WHEN coalesce(l.quality, 0) = 0 THEN 'no_gold' WHEN d.doc_id % 4 = 0 THEN 'missing_output' ELSE 'ready' END AS outcome FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "r010_dual_key_index": (
        lambda s, d: evidence.snapshots(read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("d"), F.col("o_custkey"))).alias("doc_sha"), F.concat(F.lit("f"), F.col("o_custkey")).alias("file_sha")), read(s, d, "customer").select(F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("d"), F.col("c_custkey"))).alias("doc_sha"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("f"), F.col("c_custkey"))).alias("file_sha"), F.col("c_custkey").alias("snapshot"))).select("o_orderkey", "snapshot"),
        "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN NULL WHEN o_orderkey % 3 > 0 AND c_custkey % 4 > 0 THEN c_custkey WHEN c_custkey % 5 > 0 THEN c_custkey END AS snapshot FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    ),
    "r013_page_blocks": (lambda s, d: readers.page_blocks(read(s, d, "pages")).select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.kind", "b.text"), None),
    "r014_paged_source": (
        lambda s, d: readers.paged(read(s, d, "part").select((F.col("p_partkey") % 12).alias("page"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 700).alias("url"), F.col("p_name").alias("title")), 300, ["a", "e"], ["zz"]),
        """SELECT url, p_name AS title, page FROM (SELECT p_partkey % 12 AS page, p_partkey AS pos, p_partkey % 700 AS url, p_name, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey % 12, p_partkey) AS rn
           FROM part WHERE p_partkey % 12 <= 8 AND (contains(p_name, 'a') OR contains(p_name, 'e')) AND NOT contains(p_name, 'zz')) t WHERE rn = 1 ORDER BY page, pos LIMIT 300""",
    ),
    "r020_comparison_report": (
        lambda s, d: writers.comparison_report(read(s, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("item")), 7).select("kind", "n", F.array_join(F.col("first").cast("array<string>"), ",").alias("first")),
        "SELECT kind, max(n) AS n, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (rn <= 7) AS first FROM (SELECT o_orderstatus AS kind, o_orderkey AS item, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) t GROUP BY kind",
    ),
    "r021_block_export": (
        lambda s, d: tables.block_export(tables.blocks_together(read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("pos"), F.col("text").alias("block")))),
        "SELECT conv_id AS doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, text AS block FROM conversations",
    ),
    "r022_report_bundle": (
        lambda s, d: writers.report_bundle(read(s, d, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.collect_list("o_orderkey").alias("members")), read(s, d, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("listed_run")), read(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") + (F.col("o_orderkey") % 11 == 0).cast("int")).alias("run_id"))).select("group_id", F.size("members").alias("n"), F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), "ok"),
        "SELECT o_custkey AS group_id, CAST(count(*) AS INTEGER) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0), '') AS missing, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) = 0 AS ok FROM orders GROUP BY o_custkey",
    ),
    "r024_telemetry": (
        lambda s, d: writers.telemetry(read(s, d, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("time"), F.when(F.col("event_id") % 4 == 0, "warn").alias("severity"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("none"), F.lit(None).cast("string")).alias("attributes"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("body"))).select("channel", "time", "severity", F.size("attributes").alias("n"), F.col("attributes")["user"].alias("user"), "body"),
        "SELECT event_type AS channel, event_id AS time, CASE WHEN event_id % 4 = 0 THEN 'warn' ELSE 'info' END AS severity, 1 AS n, CAST(user_id AS VARCHAR) AS user, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS body FROM events",
    ),
    "r055_evidence_support": (
        lambda s, d: read(s, d, "documents").select("doc_id", evidence.supported(F.when(F.col("doc_id") % 3 == 0, "true").when(F.col("doc_id") % 3 == 1, "2024-03-05").otherwise(F.col("lang")), F.when(F.col("doc_id") % 2 == 0, "of the").otherwise(""), F.when(F.col("doc_id") % 6 == 1, "于2024年3月5日").otherwise(F.col("text")), F.col("doc_id") % 5 == 0).alias("ok")),
        """SELECT doc_id, t IS NULL OR t = '' OR (doc_id % 2 = 0 AND contains(t, 'of the')) OR doc_id % 3 = 0 OR (doc_id % 6 = 1) OR (doc_id % 3 = 1 AND contains(t, '2024-03-05')) OR (doc_id % 3 = 2 AND contains(t, lang)) OR doc_id % 5 = 0 AS ok
           FROM (SELECT doc_id, lang, CASE WHEN doc_id % 6 = 1 THEN '于2024年3月5日' ELSE text END AS t FROM documents) x""",
    ),
    "r059_page_form": (
        lambda s, d: read(s, d, "part").select("p_partkey", tables.page_form(F.col("p_size") * 3, F.col("p_partkey") % 5 / 100, F.col("p_partkey") % 7 / 10, F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 4 / 100)).alias("f")).select("p_partkey", "f.form", "f.rule"),
        """SELECT p_partkey, CASE WHEN r = 'R1_text_layer' THEN 'text' WHEN r LIKE 'R2_no%' OR r LIKE 'R3%' THEN 'scanned' ELSE 'mixed' END AS form, r AS rule FROM (SELECT p_partkey,
             CASE WHEN p_size * 3 >= 80 AND p_partkey % 5 >= 2 THEN 'R1_text_layer' WHEN p_size * 3 < 20 AND p_partkey % 7 >= 5 THEN CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 >= 1 THEN 'R2_no_text_big_image_ink' ELSE 'R2_rejected_blank_image' END
                  WHEN p_size * 3 >= 20 AND p_partkey % 5 < 2 AND p_partkey % 7 >= 3 THEN 'R3_watermark_text_big_image' ELSE 'R4_fallback_mixed' END AS r FROM part) t""",
    ),
    "r060_unreadable_regions": (
        lambda s, d: read(s, d, "part").select("p_partkey", F.size(tables.unreadable_regions(F.array(F.array(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(50.0)), F.array(F.lit(10.0), F.lit(0.0), F.lit(5.0), F.lit(99.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), (F.col("p_partkey") % 50).cast("double"))), F.lit(100.0), F.lit(100.0))).alias("n")),
        "SELECT p_partkey, CAST(p_size * 50 >= 2500 AS INTEGER) + CAST(p_partkey % 50 >= 25 AS INTEGER) AS n FROM part",
    ),
    "r061_gold_output_outer": (
        lambda s, d: scoring.coverage(gold(s, d), output(s, d), KEY).select(*KEY, "field", "verdict"),
        duck("SELECT case_id, event_id, field, CASE WHEN max(g) = 1 AND max(o) = 1 THEN 'both' WHEN max(g) = 1 THEN 'miss' ELSE 'extra' END AS verdict FROM (SELECT case_id, event_id, field, 1 AS g, 0 AS o FROM @gold WHERE status = 'extracted' UNION ALL SELECT case_id, event_id, field, 0, 1 FROM @output WHERE status = 'extracted') t GROUP BY case_id, event_id, field"),
    ),
    "r062_run_outer": (
        lambda s, d: scoring.paired_runs(gold(s, d), output(s, d), KEY),
        duck("SELECT case_id, event_id, CASE WHEN count(*) = 2 THEN 'both' ELSE min(x) END AS side FROM (SELECT case_id, event_id, 'a' AS x FROM @gold UNION ALL SELECT case_id, event_id, 'b' FROM @output) t GROUP BY case_id, event_id"),
    ),
    "r063_evidence_in_block": (
        lambda s, d: evidence.provenance(_evidence(s, d), read(s, d, "documents").select(F.lit("s").alias("snapshot"), F.col("doc_id").alias("block_id"), "text")).select("item", "block_id", "hit", "reason"),
        """SELECT item, block_id, CASE WHEN reason LIKE 'omit%' THEN NULL ELSE reason IS NULL END AS hit, reason FROM (SELECT e.item, e.block_id, CASE WHEN e.block_id IS NULL THEN 'omit_no_block_or_quote' WHEN e.block_id % 9 = 0 THEN 'omit_no_snapshot' WHEN d.doc_id IS NULL OR d.text IS NULL AND false THEN 'block_not_found'
             WHEN NOT contains(regexp_replace(coalesce(d.text, ''), '\\s+', '', 'g'), e.lang) THEN 'quote_not_in_block' END AS reason
           FROM (SELECT doc_id AS item, lang, CASE WHEN doc_id % 8 > 0 THEN doc_id + CASE WHEN doc_id % 5 = 0 THEN 10000000 ELSE 0 END END AS block_id FROM documents) e LEFT JOIN documents d ON d.doc_id = e.block_id) t""",
    ),
    "r065_index_lookup": (
        lambda s, d: evidence.index_context(read(s, d, "part").select(F.col("p_partkey").alias("case_id")), read(s, d, "lineitem").where("l_suppkey % 7 = 1").groupBy(F.col("l_suppkey").alias("issuer")).agg(F.collect_set("l_partkey").alias("cases"))),
        "SELECT p_partkey AS case_id, CASE WHEN n = 1 THEN i END AS issuer, CASE WHEN n = 1 THEN 'known' ELSE 'unknown' END AS status FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS i FROM lineitem WHERE l_suppkey % 7 = 1 GROUP BY l_partkey) t ON l_partkey = p_partkey",
    ),
    "r066_pair_scores": (
        lambda s, d: scoring.pair_scores(_groups(s, d), _results(s, d)),
        "SELECT o_orderkey AS group_id, CASE WHEN o_orderkey % 5 = 0 THEN 'not_run' WHEN o_orderkey % 3 = o_orderkey % 2 THEN 'pass' ELSE 'fail' END AS verdict FROM orders",
    ),
    "r067_all_linked": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", scoring.all_linked(F.array(F.lit("a"), F.lit("b")), F.array(*[F.struct(F.lit(m).alias("case_id"), F.when(F.col("o_orderkey") % k > 0, "r").alias("run_id"), F.lit("v").alias("version"), (F.col("o_custkey") % k == 1).alias("mock")) for m, k in (("a", 3), ("b", 4))])).alias("ok")),
        "SELECT o_orderkey, o_orderkey % 3 > 0 AND o_custkey % 3 <> 1 AND o_orderkey % 4 > 0 AND o_custkey % 4 <> 1 AS ok FROM orders",
    ),
    "r068_expectations": (
        lambda s, d: scoring.expectations(read(s, d, "labels").select("doc_id", F.col("quality").alias("expected")), read(s, d, "documents").where("doc_id % 4 > 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("predicted")), "doc_id"),
        "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'NO_EXPECTATION' WHEN d.doc_id IS NULL THEN 'NOT_RUN' WHEN l.quality = d.doc_id % 2 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 > 0) d ON d.doc_id = l.doc_id",
    ),
    "r069_missing_parts": (
        lambda s, d: scoring.missing_parts(read(s, d, "documents"), {"label": read(s, d, "labels"), "text": read(s, d, "documents").where("n_chars > 500"), "odd": read(s, d, "documents").where("doc_id % 2 = 1")}, "doc_id").select("doc_id", F.array_join("missing", ",").alias("missing")),
        "SELECT d.doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'label' END, CASE WHEN d.doc_id % 2 = 0 THEN 'odd' END, CASE WHEN coalesce(n_chars, 0) <= 500 THEN 'text' END) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "r070_loose_pairs": (
        lambda s, d: scoring.loose_pairs(read(s, d, "events").where("event_id % 3 = 0").select("event_type", F.col("event_id").alias("id")), read(s, d, "events").where("event_id % 4 = 0").select("event_type", F.col("event_id").alias("id")), ["event_type"], "id"),
        """SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.k, b.k) AS ordinal, a.event_id AS a_id, b.event_id AS b_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS k FROM events WHERE event_id % 3 = 0) a
           FULL JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS k FROM events WHERE event_id % 4 = 0) b ON b.event_type = a.event_type AND b.k = a.k""",
    ),
    "r071_sha_then_id": (
        lambda s, d: scoring.sha_then_id(read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("h"), F.col("o_orderkey")).alias("sha"), F.col("o_custkey").alias("case_id")), read(s, d, "customer").select(F.col("c_custkey").alias("envelope"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), F.col("c_custkey"))).alias("sha"), F.col("c_custkey").alias("case_id"))),
        """SELECT o_orderkey AS doc_id, CASE WHEN a.c_custkey IS NOT NULL THEN a.c_custkey ELSE b.c_custkey END AS envelope, CASE WHEN a.c_custkey IS NOT NULL THEN 'sha' WHEN b.c_custkey IS NOT NULL THEN 'case_id' ELSE 'none' END AS matched_by
           FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) a ON a.c_custkey = o_orderkey LEFT JOIN customer b ON b.c_custkey = o_custkey""",
    ),
    "r072_continued_tables": (
        lambda s, d: tables.continued_tables(*_tables(s, d)),
        """SELECT b.doc_id, b.page, concat('t', b.page, '.0') AS table_id, concat('t', a.page, '.', a.n - 1) AS continued_from FROM (SELECT o_orderkey // 8 AS doc_id, o_orderkey % 8 AS page, o_custkey AS c, 1 + o_custkey % 2 AS n FROM orders) a
           JOIN (SELECT o_orderkey // 8 AS doc_id, o_orderkey % 8 AS page, o_custkey AS c FROM orders) b ON b.doc_id = a.doc_id AND b.page = a.page + 1
           WHERE 3 + a.c % 2 = 3 + b.c % 2 AND abs(a.c % 5 - b.c % 5) <= 2 AND a.c % 3 > 0 AND b.c % 4 > 0""",
    ),
    "r073_torn_cells": (
        lambda s, d: _torn(s, d),
        """WITH c AS (SELECT b.doc_id, b.page, b.c, a.page AS p, a.n, b.c % 2 AS odd FROM (SELECT o_orderkey // 8 AS doc_id, o_orderkey % 8 AS page, o_custkey AS c, 1 + o_custkey % 2 AS n FROM orders) a
             JOIN (SELECT o_orderkey // 8 AS doc_id, o_orderkey % 8 AS page, o_custkey AS c FROM orders) b ON b.doc_id = a.doc_id AND b.page = a.page + 1 WHERE a.c % 2 = b.c % 2 AND abs(a.c % 5 - b.c % 5) <= 2 AND a.c % 3 > 0 AND b.c % 4 > 0)
           SELECT doc_id, concat('t', page, '.0') AS table_id, 0 AS col, concat('t', p, '.', n - 1, ':1:0') AS continues FROM c WHERE c % 6 < 3""",
    ),
    "r077_run_links": (
        lambda s, d: rules.consistent_links(read(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3).alias("link_run"), F.lit("0.3").alias("link_version")), read(s, d, "orders").where("o_orderkey % 6 > 0").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 3).alias("run_id"), F.when(F.col("o_custkey") % 4 > 0, "0.3").otherwise("0.2").alias("schema_version"))),
        "SELECT o_orderkey AS case_id, o_orderkey % 6 > 0 AND o_custkey % 3 = o_orderkey % 3 AND o_custkey % 4 > 0 AS ok FROM orders",
    ),
    "r078_unique_candidate": (
        lambda s, d: evidence.unique_candidate(read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("st")), read(s, d, "orders").where("o_orderkey % 5 < 2").select(F.col("o_orderkey").alias("conflict_id"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("st")), ["k", "st"]),
        "SELECT o.o_orderkey AS id, CASE WHEN n = 1 THEN c END AS conflict_id FROM orders o LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS c FROM orders WHERE o_orderkey % 5 < 2 GROUP BY ALL) t ON t.o_custkey = o.o_custkey AND t.o_orderstatus = o.o_orderstatus",
    ),
    "r079_offset_profile": (
        lambda s, d: evidence.offset_profile(read(s, d, "lineitem").select(F.concat(F.lit("p1_b"), F.col("l_linenumber")).alias("a"), F.when(F.col("l_partkey") % 9 == 0, "none").otherwise(F.concat(F.lit("x9b"), F.col("l_suppkey") % 13)).alias("b")), "a", "b"),
        'SELECT l_suppkey % 13 - l_linenumber AS "offset", count(*) AS n FROM lineitem WHERE l_partkey % 9 > 0 GROUP BY 1',
    ),
    "r081_tiered_alignment": (
        lambda s, d: scoring.aligned(*_aligned_sides(s, d), ["holder", "direction"], ["number"])[0],
        duck("""WITH g AS (SELECT *, p % 3 AS h, q % 2 AS dr, row_number() OVER (PARTITION BY case_id, p % 3, q % 2 ORDER BY event_id) AS rn FROM @gold),
                  o AS (SELECT case_id, event_id, (p + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END) % 3 AS h, q % 2 AS dr, q AS num, row_number() OVER (PARTITION BY case_id, (p + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END) % 3, q % 2 ORDER BY event_id) AS rn FROM gold WHERE s % 9 > 0),
                  x AS (SELECT g.case_id, g.event_id AS gold_id, o.event_id AS output_id FROM g JOIN o ON o.case_id = g.case_id AND o.h = g.h AND o.dr = g.dr AND o.rn = g.rn),
                  gl AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.case_id = g.case_id AND x.gold_id = g.event_id)), ol AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.case_id = o.case_id AND x.output_id = o.event_id)),
                  y AS (SELECT gl.case_id, gl.event_id AS gold_id, ol.event_id AS output_id FROM gl JOIN ol ON ol.case_id = gl.case_id WHERE (SELECT count(*) FROM g z WHERE z.case_id = gl.case_id) = 1 AND (SELECT count(*) FROM o z WHERE z.case_id = gl.case_id) = 1),
                  g2 AS (SELECT *, row_number() OVER (PARTITION BY case_id, q ORDER BY event_id) AS r2 FROM gl WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.case_id = gl.case_id)), o2 AS (SELECT * FROM ol WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.case_id = ol.case_id)),
                  w AS (SELECT g2.case_id, g2.event_id AS gold_id, (SELECT min(event_id) FROM o2 WHERE o2.case_id = g2.case_id AND o2.num = g2.q) AS output_id FROM g2 WHERE r2 = 1 AND (SELECT count(*) FROM o2 WHERE o2.case_id = g2.case_id AND o2.num = g2.q) = 1),
                  f AS (SELECT *, 'exact_key' AS alignment FROM x UNION ALL SELECT *, 'single_event_fallback' FROM y UNION ALL SELECT *, 'numeric_fallback' FROM w)
                SELECT g.case_id, g.event_id AS gold_id, f.output_id, coalesce(f.alignment, 'missing_event') AS alignment FROM g LEFT JOIN f ON f.case_id = g.case_id AND f.gold_id = g.event_id"""),
    ),
    "r082_field_verdicts": (
        lambda s, d: gold(s, d).join(output(s, d).select(*KEY, "field", F.col("status").alias("us"), F.col("value").alias("uv")), [*KEY, "field"], "left").select(*KEY, "field", scoring.field_verdict(F.col("status"), F.col("value"), F.col("us"), F.col("uv"), F.col("field") == "f2").alias("verdict")),
        duck(f"""SELECT g.case_id, g.event_id, g.field, CASE WHEN o.case_id IS NULL THEN 'MISSING_FIELD' WHEN g.status <> o.status AND {_HAS('g')} AND NOT {_HAS('o')} THEN 'MISSING_VALUE' WHEN g.status <> o.status AND NOT {_HAS('g')} AND {_HAS('o')} THEN 'WRONG_FILLED'
                  WHEN g.status <> o.status THEN 'STATUS_DIFF' WHEN {_HAS('g')} AND (CASE WHEN g.field = 'f2' THEN ltrim(g.value, '-') ELSE g.value END) IS DISTINCT FROM (CASE WHEN g.field = 'f2' THEN ltrim(o.value, '-') ELSE o.value END) THEN 'VALUE_DIFF' END AS verdict
                FROM @gold g LEFT JOIN @output o ON o.case_id = g.case_id AND o.event_id = g.event_id AND o.field = g.field"""),
    ),
    "r083_held_out": (
        lambda s, d: scoring.held_out(read(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("k"), F.when(F.col("o_custkey") % 3 == 0, "1,500").when(F.col("o_custkey") % 3 == 1, "a b").otherwise("1500.0").alias("expected")), read(s, d, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("event_id"), F.when(F.col("c_nationkey") % 2 == 0, " 1500").otherwise("ab").alias("value")).unionByName(read(s, d, "customer").where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("event_id"), F.lit("x").alias("value"))), ["k"]),
        """SELECT o_orderkey AS case_id, n, CASE WHEN n <> 1 THEN 'not_unique' WHEN ok THEN 'match' ELSE 'mismatch' END AS verdict FROM (SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 0 ELSE CAST(c_custkey % 4 > 0 AS INT) + CAST(c_custkey % 10 = 1 AS INT) END AS n,
             CASE WHEN c_custkey % 10 = 1 AND c_custkey % 4 = 0 THEN false WHEN o_custkey % 3 = 1 THEN c_nationkey % 2 = 1 ELSE c_nationkey % 2 = 0 END AS ok FROM orders LEFT JOIN customer ON c_custkey = o_custkey) t""",
    ),
    "r091_sample_summary": (
        lambda s, d: scoring.sample_summary(gold(s, d), output(s, d), KEY),
        duck(f"""SELECT *, hits / nullif(CAST(fields AS DOUBLE), 0) AS agreement, normalized / nullif(CAST(numeric_fields AS DOUBLE), 0) AS end_to_end, normalized / nullif(CAST(attempted AS DOUBLE), 0) AS conditional, wrong_fill / nullif(CAST(empty AS DOUBLE), 0) AS wrong_fill_rate FROM (
                  SELECT count(*) FILTER (v) AS fields, count(*) FILTER (v AND same) AS hits, count(*) FILTER (v AND num) AS numeric_fields, count(*) FILTER (v AND num AND att) AS attempted, count(*) FILTER (v AND num AND att AND std) AS normalized,
                         count(*) FILTER (e) AS empty, count(*) FILTER (e AND ov IS NOT NULL) AS wrong_fill, count(*) FILTER (e) AS legacy_empty, count(*) FILTER (e AND ov IS NOT NULL) AS legacy_wrong_fill
                  FROM (SELECT g.status = 'extracted' AND g.value IS NOT NULL AS v, g.unit <> 'text' AS num, g.status IN ('not_mentioned', 'unreadable') AS e, o.value AS ov, coalesce(o.status = 'extracted' AND o.value IS NOT NULL, false) AS att, coalesce(o.standardized, false) AS std,
                          coalesce(g.status = o.status AND CASE WHEN g.unit = 'text' THEN g.value = o.value ELSE CAST(g.value AS DOUBLE) = CAST(o.value AS DOUBLE) END, false) AS same
                        FROM @gold g LEFT JOIN @output o ON o.case_id = g.case_id AND o.event_id = g.event_id AND o.field = g.field) a) b"""),
    ),
    "r092_value_equivalence": (
        lambda s, d: gold(s, d).join(output(s, d).select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("status", "unit", "denominator", "value")]), KEY).select(*KEY, scoring.equivalent(F.col("field"), F.col("status"), F.col("unit"), F.col("denominator"), F.col("value"), F.col("o_status"), F.col("o_unit"), F.col("o_denominator"), F.col("o_value")).alias("same")),
        duck("SELECT g.case_id, g.event_id, g.status = o.status AND CASE WHEN g.unit = 'text' THEN g.value IS NOT DISTINCT FROM o.value ELSE coalesce(CAST(g.value AS DOUBLE) = CAST(o.value AS DOUBLE), false) END AS same FROM @gold g JOIN @output o ON o.case_id = g.case_id AND o.event_id = g.event_id"),
    ),
    "r093_cohort_counts": (
        lambda s, d: scoring.cohort_counts(read(s, d, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "core").otherwise("adversarial").alias("cohort"), F.element_at(F.array(F.lit("completed"), F.lit("failed"), F.lit("skipped")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("execution")), ("core", "adversarial", "scan"), ("completed", "failed", "skipped")),
        "SELECT c AS cohort, count(o_orderkey) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS completed, count(*) FILTER (o_orderkey % 3 = 1) AS failed, count(*) FILTER (o_orderkey % 3 = 2) AS skipped FROM (VALUES ('core', 0), ('adversarial', 1), ('scan', 2)) v(c, k) LEFT JOIN orders ON o_custkey % 2 = k GROUP BY c",
    ),
    "r095_status_histogram": (
        lambda s, d: scoring.histogram(gold(s, d), "status", scoring.STATUSES),
        duck("SELECT v.s AS value, count(g.case_id) AS n FROM (VALUES ('extracted'), ('not_disclosed'), ('not_applicable'), ('not_mentioned'), ('unreadable'), ('needs_review')) v(s) LEFT JOIN @gold g ON g.status = v.s GROUP BY v.s"),
    ),
    "r097_standardisation": (
        lambda s, d: scoring.standardisation(output(s, d)),
        duck("""SELECT *, standardized * 100.0 / non_text AS share, valued * 100.0 / (valued + abstained) AS share_valued FROM (SELECT count(value) AS valued, count(*) - count(value) AS abstained, count(value) FILTER (unit = 'text') AS text, count(value) FILTER (unit <> 'text') AS non_text,
                  count(value) FILTER (unit <> 'text' AND standardized) AS standardized, count(*) FILTER (value IS NULL AND standardized) AS violations FROM @output) t""").replace("standardized * 100.0 / non_text", "CAST(standardized * 100 AS DOUBLE) / non_text").replace("valued * 100.0 / (valued", "CAST(valued * 100 AS DOUBLE) / (valued"),
    ),
    "r098_strength_distribution": (
        lambda s, d: scoring.histogram(_tiers(s, d).select(F.col("t.strength").alias("strength")), "strength", scoring.STRENGTHS),
        """SELECT v.s AS value, count(t.x) AS n FROM (VALUES ('strong'), ('medium'), ('weak'), ('none'), ('conflict'), ('unknown')) v(s) LEFT JOIN (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'conflict' WHEN l_partkey % 2 = 0 AND l_suppkey % 2 = 0 THEN 'strong' WHEN l_partkey % 3 = 0 THEN 'medium' WHEN l_partkey % 5 = 0 THEN 'weak' ELSE 'none' END AS x FROM lineitem) t ON t.x = v.s GROUP BY v.s""",
    ),
    "r099_provenance_summary": (
        lambda s, d: evidence.provenance_summary(evidence.provenance(_evidence(s, d), read(s, d, "documents").select(F.lit("s").alias("snapshot"), F.col("doc_id").alias("block_id"), "text"))),
        """SELECT count(*) AS total, count(*) FILTER (r = 'hit') AS hit, count(*) FILTER (r = 'miss') AS miss, count(*) FILTER (r = 'snap') AS omit_no_snapshot, count(*) FILTER (r = 'quote') AS omit_no_block_or_quote FROM (SELECT CASE WHEN e.block_id IS NULL THEN 'quote' WHEN e.block_id % 9 = 0 THEN 'snap'
             WHEN d.doc_id IS NOT NULL AND contains(regexp_replace(coalesce(d.text, ''), '\\s+', '', 'g'), e.lang) THEN 'hit' ELSE 'miss' END AS r FROM (SELECT lang, CASE WHEN doc_id % 8 > 0 THEN doc_id + CASE WHEN doc_id % 5 = 0 THEN 10000000 ELSE 0 END END AS block_id FROM documents) e LEFT JOIN documents d ON d.doc_id = e.block_id) t""",
    ),
    "r100_run_counters": (
        lambda s, d: scoring.run_counters(gold(s, d), output(s, d), "case_id", ["event_id"]),
        duck("""WITH f AS (SELECT coalesce(g.case_id, o.case_id) AS c, g.case_id IS NOT NULL AND o.case_id IS NOT NULL AS paired, g.value AS gv, o.value AS ov, g.status AS gs, o.status AS os FROM @gold g FULL JOIN @output o ON o.case_id = g.case_id AND o.event_id = g.event_id AND o.field = g.field),
                  d AS (SELECT c, count(*) FILTER (paired AND (gv IS NOT NULL OR ov IS NOT NULL)) AS v, count(*) FILTER (paired AND gv IS DISTINCT FROM ov) AS x, count(*) FILTER (paired AND gs <> os AND gv IS NULL AND ov IS NULL) AS n, bool_and(paired AND gv IS NOT DISTINCT FROM ov AND gs = os) AS same
                        FROM f WHERE c IN (SELECT case_id FROM gold) AND c IN (SELECT case_id FROM output) GROUP BY c)
                SELECT count(*) AS docs, count(*) FILTER (same) AS business_identical, CAST(sum(v) AS BIGINT) AS value_slots, CAST(sum(x) AS BIGINT) AS value_slots_differ, CAST(sum(n) AS BIGINT) AS null_status_flips FROM d"""),
    ),
    "r101_exact_decimal_sum": (
        lambda s, d: decimals.exact_sum(numbers(s, d).where("s not in ('1e3', '1,000')"), ["l_orderkey"], F.col("s")),
        duck(f"SELECT l_orderkey, CASE WHEN count(*) = count(x) THEN {_PLAIN('sum(x)')} END AS total FROM (SELECT l_orderkey, {_DEC} AS x FROM @numbers WHERE s NOT IN ('1e3', '1,000')) t GROUP BY l_orderkey"),
    ),
    "r102_total_equals_parts": (
        lambda s, d: gold(s, d).groupBy("case_id").agg(F.sum("q").alias("parts"), F.bool_and(F.col("status") == "extracted").alias("anchored")).join(read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg((F.sum((F.col("l_quantity") - 20).cast("long"))).alias("total")), "case_id").select("case_id", ((F.col("parts") == F.col("total")) & F.col("anchored")).alias("ok")),
        duck("SELECT a.case_id, a.parts = b.total AND a.anchored AS ok FROM (SELECT case_id, sum(q) AS parts, bool_and(status = 'extracted') AS anchored FROM @gold GROUP BY case_id) a JOIN (SELECT l_orderkey, sum(CAST(l_quantity - 20 AS BIGINT)) AS total FROM lineitem GROUP BY l_orderkey) b ON b.l_orderkey = a.case_id"),
    ),
    "r112_status_map": (
        lambda s, d: scoring.status_map(gold(s, d), "event_id").select("event_id", F.explode("counts").alias("status", "n")),
        duck("SELECT event_id, status, count(*) AS n FROM @gold GROUP BY event_id, status"),
    ),
    "r124_paragraph_pairs": (
        lambda s, d: tables.paragraph_pairs(_blocks(s, d)),
        """SELECT conv_id AS doc_id, turn AS pos, t AS text, CASE WHEN ok0 AND pg0 = pg AND right(b0, 1) <> '。' THEN t0 || t END AS joined FROM (SELECT *, lag(ok) OVER w AS ok0, lag(pg) OVER w AS pg0, lag(b) OVER w AS b0, lag(t) OVER w AS t0 FROM (
             SELECT conv_id, turn, turn // 3 + 1 AS pg, concat(role, CASE WHEN turn % 4 = 0 THEN '。' ELSE '' END) AS b, concat(role, CASE WHEN turn % 4 = 0 THEN '。' ELSE '' END) AS t, turn % 5 <> 2 AS ok FROM conversations) a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE ok""",
    ),
    "r126_dense_sequence": (
        lambda s, d: logs.sequence_checks(frame(s, d, "log").where("event_id % 97 <> 5")).select("session_id", "dense"),
        duck("SELECT session_id, max(seq) = count(*) - 1 AS dense FROM @log WHERE event_id % 97 <> 5 GROUP BY session_id"),
    ),
    "r130_head_and_tail": (lambda s, d: retention.head_and_tail(read(s, d, "conversations").groupBy(F.col("conv_id").alias("message_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 2, "image").otherwise("text").alias("type"), "text"))).alias("content")).select("message_id", F.transform("content", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"))).alias("content")), 90, 20).select("message_id", F.size("head").alias("head"), F.size("tail").alias("tail"), "omitted_bytes", "omitted_images"), None),
    "r138_fuzzy_rank": (lambda s, d: search.rank_names(read(s, d, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("pos")), "ae", "p_name").select("p_partkey", "prefix", "score"), None),
    "r142_maximum": (lambda s, d: frame(s, d, "spans").groupBy("user_id").agg(F.max(F.col("ended") - F.col("began")).alias("longest")), duck("SELECT user_id, max(ended - began) AS longest FROM @spans GROUP BY user_id")),
    "r146_out_of_scope": (lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "r147_live_persisted": (
        lambda s, d: _observed(s, d),
        "SELECT k AS id, bool_or(live) AS live, bool_or(NOT live) AS persisted, count(DISTINCT h) > 1 AS conflict FROM (SELECT c_custkey AS k, c_nationkey AS h, true AS live FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END, false FROM customer WHERE c_custkey % 4 > 0) t GROUP BY k",
    ),
    "r151_strict_decimal": (lambda s, d: numbers(s, d).select("l_orderkey", "l_partkey", "l_linenumber", "s", decimals.parse(F.col("s")).alias("v")), duck(f"SELECT l_orderkey, l_partkey, l_linenumber, s, CASE WHEN {_NUM} THEN {_PLAIN(f'({_DEC})')} END AS v FROM @numbers").replace("CAST((CASE", "CAST((CASE")),
    "r152_decimal_multiply": (
        lambda s, d: numbers(s, d).select("l_orderkey", "l_partkey", "l_linenumber", decimals.multiply(F.col("s"), F.lit("-12.5")).alias("v")),
        duck(f"SELECT l_orderkey, l_partkey, l_linenumber, {_PLAIN('x')} AS v FROM (SELECT *, CASE WHEN {_NUM} THEN CAST(CAST(trim(s) AS DECIMAL(18,3)) * CAST('-12.5' AS DECIMAL(4,1)) AS DECIMAL(30,4)) END AS x FROM @numbers) t"),
    ),
    "r153_decimal_compare": (lambda s, d: numbers(s, d).select("l_orderkey", "l_partkey", "l_linenumber", decimals.compare(F.col("s"), F.lit("700.50")).alias("c")), duck(f"SELECT l_orderkey, l_partkey, l_linenumber, CAST(sign(x - 700.50) AS INTEGER) AS c FROM (SELECT *, {_DEC} AS x FROM @numbers) t")),
    "r154_half_up": (
        lambda s, d: numbers(s, d).select("l_orderkey", "l_partkey", "l_linenumber", decimals.round_half_up(F.col("s"), 1).alias("tenth"), decimals.round_half_up(F.col("s"), -2).alias("hundreds")),
        duck(f"SELECT l_orderkey, l_partkey, l_linenumber, {_PLAIN('t')} AS tenth, {_PLAIN('h')} AS hundreds FROM (SELECT *, CAST(sign(x) * floor(abs(x) * 10 + 0.5) / 10 AS DECIMAL(20,1)) AS t, CAST(CAST(sign(x) * floor(abs(x) / 100 + 0.5) AS BIGINT) * 100 AS BIGINT) AS h FROM (SELECT *, {_DEC} AS x FROM @numbers) a) b"),
    ),
    "r155_decimal_shift": (
        lambda s, d: numbers(s, d).select("l_orderkey", "l_partkey", "l_linenumber", decimals.shift(decimals.parse(F.col("s")), 4).alias("v4"), decimals.shift(decimals.parse(F.col("s")), 1).alias("v1")),
        duck(f"SELECT l_orderkey, l_partkey, l_linenumber, {_PLAIN('CAST(x * 10000 AS DECIMAL(30,4))')} AS v4, {_PLAIN('CAST(x * 10 AS DECIMAL(30,4))')} AS v1 FROM (SELECT *, {_DEC} AS x FROM @numbers) t"),
    ),
    "r156_measure": (
        lambda s, d: kinds(s, d).select("l_orderkey", decimals.measure(F.col("kind"), F.col("status"), F.lit("single"), F.col("raw"), F.col("raw"), F.col("unit"), F.col("qualifier"), F.col("den"), F.when(F.col("den").isNotNull(), "as stated")).alias("m")).select("l_orderkey", "m.value", "m.unit", "m.error"),
        f"WITH {_MEASURES} SELECT l_orderkey, CASE WHEN error IS NULL AND status <> 'not_mentioned' THEN {_PLAIN('v')} END AS value, CASE WHEN error IS NULL THEN CASE kind WHEN 'amount' THEN '元' WHEN 'shares' THEN '股' ELSE '%' END END AS unit, error FROM m4",
    ),
    "r157_stated_value": (
        lambda s, d: numbers(s, d).select("l_orderkey", "l_partkey", "l_linenumber", decimals.stated_value(F.col("s"), F.when(F.col("l_partkey") % 3 == 0, "万股").when(F.col("l_partkey") % 3 == 1, "股").otherwise("元")).alias("v")),
        duck(f"SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) END AS v FROM (SELECT *, x * CASE l_partkey % 3 WHEN 0 THEN 10000 WHEN 1 THEN 1 END AS y FROM (SELECT *, {_DEC} AS x FROM @numbers) a) b"),
    ),
    "r158_compact_text": (lambda s, d: read(s, d, "documents").select("doc_id", texts.compact(F.concat(F.lit("　 ﻿"), F.col("text"))).alias("compact")), "SELECT doc_id, coalesce(regexp_replace(text, '\\s+', '', 'g'), '') AS compact FROM documents"),
    "r159_nfkc": (lambda s, d: read(s, d, "part").select("p_partkey", texts.folded(F.concat(F.lit("Ａ１ ﬁ　①"), F.col("p_name"))).alias("folded")), "SELECT p_partkey, concat('A1fi1', replace(p_name, ' ', '')) AS folded FROM part"),
    "r160_chinese_date": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", texts.chinese_date(F.when(F.col("o_orderkey") % 4 == 0, "2024年3月").otherwise(F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.day("o_orderdate"), F.lit("日")))).alias("day")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '2024年3月' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    ),
    "r161_business_date": (lambda s, d: read(s, d, "events").select("event_id", texts.business_date(F.col("ts").cast("timestamp")).alias("day")), "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events"),
    "r162_token_estimate": (lambda s, d: read(s, d, "conversations").groupBy("conv_id").agg(F.sum(texts.token_estimate(F.concat(F.col("text"), F.lit("𝕏"))) + 4).alias("tokens")), "SELECT conv_id, CAST(sum(CAST(ceil((length(text) + 2) / 4.0) AS BIGINT) + 8) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id"),
    "r163_byte_cut": (
        lambda s, d: read(s, d, "documents").select("doc_id", texts.byte_cut(F.concat(F.lit("é漢𝕏"), F.col("text")), 30).alias("cut")),
        "SELECT doc_id, CASE WHEN strlen(t) <= 30 THEN t ELSE (SELECT left(t, max(n)) FROM range(7, 31) r(n) WHERE strlen(left(t, n)) <= 30) END AS cut FROM (SELECT doc_id, 'é漢𝕏' || text AS t FROM documents) x",
    ),
    "r164_code_point_slice": (lambda s, d: read(s, d, "part").select("p_partkey", texts.end_slice(F.concat(F.lit("𝕏é"), "p_name"), 3).alias("head"), texts.end_slice(F.concat("p_name", F.lit("漢𝕏")), 4, True).alias("tail")), "SELECT p_partkey, '𝕏é' || left(p_name, 1) AS head, right(p_name, 2) || '漢𝕏' AS tail FROM part"),
    "r167_box_validity": (
        lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(values.box_issue(F.when(F.col("p_partkey") % 9 > 0, F.array((F.col("p_size") - 5).cast("double"), F.lit(1.0), (F.col("p_partkey") % 40).cast("double"), (F.col("p_partkey") % 3).cast("double")))), ",").alias("issues")),
        "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat_ws(',', CASE WHEN p_size < 5 THEN 'negative' END, CASE WHEN p_size - 5 >= p_partkey % 40 THEN 'left_right' END, CASE WHEN p_partkey % 3 <= 1 THEN 'top_bottom' END) END AS issues FROM part",
    ),
    "r168_page_bounds": (
        lambda s, d: read(s, d, "part").select("p_partkey", values.outside_page(F.when(F.col("p_partkey") % 9 > 0, F.array(F.lit(0.0), F.lit(-0.5), (F.col("p_size") * 2).cast("double"), F.lit(70.0))), F.when(F.col("p_partkey") % 4 > 0, F.lit(59.5)), F.lit(70.0)).alias("outside")),
        "SELECT p_partkey, p_partkey % 9 > 0 AND p_partkey % 4 > 0 AND p_size * 2 > 60 AS outside FROM part",
    ),
    "r169_json_schema": (
        lambda s, d: read(s, d, "events").select("event_id", F.array_join(values.validator(SCHEMA)(_json(F)), ",").alias("issues")),
        """SELECT event_id, CASE WHEN event_id % 8 = 7 THEN '$: json' ELSE concat_ws(',', CASE WHEN event_id % 8 = 1 THEN '$.kind: required' END, CASE WHEN event_id % 8 = 6 THEN '$.id: type' WHEN event_id < 10 THEN '$.id: minimum' END,
             CASE WHEN event_id % 8 <> 1 AND event_type NOT IN ('view', 'click', 'purchase') THEN '$.kind: enum' END, CASE WHEN event_id % 8 = 3 THEN '$.note: anyOf' END, CASE WHEN event_id % 8 = 4 THEN '$.more: not_allowed' END) END AS issues FROM events""",
    ),
    "r170_deep_equality": (
        lambda s, d: read(s, d, "events").select("event_id", values.deep_equal(F.concat(F.lit('{"a": [1, {"x": null}], "b": '), F.col("event_id"), F.lit("}")), F.when(F.col("event_id") % 4 == 0, "{").when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"b":'), F.col("event_id"), F.lit('.0,"a":[1,{"x":null}]}'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"b":'), F.col("event_id"), F.lit(',"a":[{"x":null},1]}'))).otherwise(F.concat(F.lit('{"b":'), F.col("event_id"), F.lit(',"a":[true,{"x":null}]}')))).alias("same")),
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS same FROM events",
    ),
    "r171_json_snapshot": (
        lambda s, d: read(s, d, "events").select("event_id", values.snapshot(F.when(F.col("event_id") % 3 == 0, '{"a": NaN}').otherwise(F.concat(F.lit('{ "b" : 1, "a" : "'), F.col("event_type"), F.lit('"}')))).alias("json")),
        """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN concat('{"a":"', event_type, '","b":1}') END AS json FROM events""",
    ),
    "r172_safe_count": (
        lambda s, d: read(s, d, "events").select("event_id", values.safe_count(F.element_at(F.array(F.col("event_id").cast("string"), F.lit("9007199254740991"), F.lit("9007199254740992"), F.lit("-0"), F.lit("1.0"), F.lit("-3"), F.lit("007")), (F.col("event_id") % 7 + 1).cast("int"))).alias("n")),
        "SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_id WHEN 1 THEN 9007199254740991 END AS n FROM events",
    ),
    "r173_block_keys": (
        lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_partkey", F.struct(F.when(F.col("l_linenumber") % 3 > 0, "cell").otherwise("paragraph").alias("source_type"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("R"), F.col("l_linenumber"), F.lit("C"), F.col("l_suppkey") % 5)).alias("cell_ref")).alias("k")).select("l_orderkey", "l_partkey", "k.source_type", "k.cell_ref"),
        "SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 3 > 0 THEN 'cell' ELSE 'paragraph' END AS source_type, CASE WHEN l_linenumber % 3 > 0 THEN concat('R', l_linenumber, 'C', l_suppkey % 5) END AS cell_ref FROM lineitem",
    ),
    "r174_projection_unit": (lambda s, d: _streamed(s, d), duck("SELECT session_id, count(*) FILTER (seq % 8 = 0) AS turns, count(*) FILTER (seq % 8 = 7) AS answered FROM @log GROUP BY session_id")),
    "r175_tail_replay": (lambda s, d: _outline(s, d, 20), None),
    "r176_cache_identity": (
        lambda s, d: projections.usable(read(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 5 > 0, 4).alias("format"), (F.col("o_custkey") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("created_at"), F.lit(None).cast("string").alias("cwd"), F.when(F.col("o_orderkey") % 3 == 0, False).alias("seeded"), F.lit(None).cast("int").alias("inherited")), read(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("created_at"), F.when(F.col("o_orderkey") % 11 == 0, "w").alias("cwd"), F.lit(False).alias("seeded"), F.lit(0).alias("inherited")), 4).select("session_id"),
        "SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0",
    ),
    "r177_bad_records": (
        lambda s, d: readers.quarantined(readers.read_unit(read(s, d, "events").select(F.col("event_type").alias("tbl"), F.col("event_id").alias("key"), F.when(F.col("event_id") % 6 == 0, "{bad").otherwise(F.concat(F.lit('{"u":'), F.col("user_id"), F.lit("}"))).alias("value")), {"purchase": "u bigint"})["purchase"], True)[0].select("key", "record.u"),
        "SELECT event_id AS key, user_id AS u FROM events WHERE event_type = 'purchase' AND event_id % 6 > 0",
    ),
    "r005_zstd_frames": (lambda s, d: _frames(s, d), "SELECT conv_id, turn, 2 AS frames, turn % 3 = 0 AS torn, true AS whole FROM conversations"),
    "r008_envelope_folder": (lambda s, d: _envelopes(s, d), "SELECT n_nationkey, n_name FROM nation"),
    "r011_mirror": (lambda s, d: s.createDataFrame([(readers.mirrored(s, d, "orders.parquet", "mirror")[len(d) + 1 :], readers.mirrored(s, d, "none.parquet", "mirror")[len(d) + 1 :])], "there string, missing string"), "SELECT 'orders.parquet' AS there, 'none.parquet' AS missing"),
    "r012_revisions": (lambda s, d: s.createDataFrame([(r, readers.by_revision("c", "a.json", r)) for r in ("r1", "r2")], "revision string, path string"), "SELECT r AS revision, concat('c/', left(sha256(concat(r, ':a.json')), 16), '/a.json') AS path FROM (VALUES ('r1'), ('r2')) v(r)"),
    "r015_file_search": (lambda s, d: _grepped(s, d), "SELECT text AS line, false AS more FROM (SELECT replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM conversations) t WHERE contains(text, 'the')"),
    "r035_envelope_reshape": (
        lambda s, d: envelopes.as_envelope(envelopes.sides(_events(s, d))).select("o_orderkey", F.explode("fields").alias("field", "value")),
        "SELECT o_orderkey, u.f AS field, CASE u.f WHEN 'direction' THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders, (VALUES ('holder'), ('direction'), ('shares_before'), ('ratio_cumulative_of_held'), ('pledged_shares_this_time')) u(f)",
    ),
    "r036_identity_split": (
        lambda s, d: envelopes.sides(_events(s, d)).select("o_orderkey", F.size("identity").alias("n"), F.col("identity")["holder"].alias("holder"), F.col("identity")["direction"].alias("direction"), F.col("basis")["currency"].alias("currency"), *[F.col("observations")[f]["scope"].alias(n) for f, n in (("shares_before", "s1"), ("ratio_cumulative_of_held", "s2"), ("pledged_shares_this_time", "s3"), ("holder", "s4"))]),
        "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 6 END AS n, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) END AS holder, CASE WHEN o_orderkey % 4 < 2 THEN o_orderstatus END AS direction, CAST(NULL AS VARCHAR) AS currency, 'before' AS s1, 'cumulative' AS s2, 'single' AS s3, 'unknown' AS s4 FROM orders",
    ),
    "r145_extra_rows": (lambda s, d: output(s, d).join(gold(s, d).select(*KEY), KEY, "left_anti").select(*KEY), duck("SELECT case_id, event_id FROM @output EXCEPT SELECT case_id, event_id FROM @gold")),
    "r194_plugin_adapter": (
        lambda s, d: rules.adapted(_conflicts(s, d).select("k"), lambda df: df.where("k % 3 > 0").select("k", F.when(F.col("k") % 3 == 1, "conflict").otherwise("strange").alias("verdict")), "k"),
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN 'true_conflict' ELSE 'insufficient_evidence' END AS result FROM orders",
    ),
    "r006_unit_scan": (
        lambda s, d: readers.read_unit(read(s, d, "events").select(F.col("event_type").alias("tbl"), F.col("event_id").alias("key"), F.when(F.col("event_id") % 6 == 0, "{bad").otherwise(F.concat(F.lit('{"u":'), F.col("user_id"), F.lit("}"))).alias("value")), {"click": "u bigint"})["click"].select("key", F.col("record.u").alias("u"), "bad"),
        "SELECT event_id AS key, CASE WHEN event_id % 6 > 0 THEN user_id END AS u, event_id % 6 = 0 AS bad FROM events WHERE event_type = 'click'",
    ),
    "r193_plugin_rules": (
        lambda s, d: rules.with_plugins(_conflicts(s, d), [("BROKEN", lambda df: df.select("k", F.col("no_such").alias("result"))), ("TAX", lambda df: df.select("k", F.when(F.col("k") % 9 == 0, "caliber_tax").alias("result")))], "k", rules.attribute)[0],
        None,
    ),
    "r195_attribution_chain": (
        lambda s, d: rules.attribute(_conflicts(s, d)).select("k", "rule", "result"),
        duck("""SELECT k, rule, CASE rule WHEN 'INSUFFICIENT_EVIDENCE' THEN 'insufficient_evidence' WHEN 'UNIT_SCALE_MISMATCH' THEN 'caliber_unit_scale' WHEN 'CUMULATIVE_VS_INCREMENTAL' THEN 'caliber_cumulative' WHEN 'CURRENCY_EQUIV' THEN 'caliber_currency'
                  WHEN 'SAME_QUOTE_DIFFERENT_NUMBER' THEN 'true_conflict' WHEN 'TEMPORAL_PROGRESSION' THEN 'temporal_progression' ELSE rule END AS result
                FROM (SELECT k, CASE WHEN insufficient THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 8 < 2 THEN 'UNIT_SCALE_MISMATCH' WHEN k % 8 = 6 THEN 'CUMULATIVE_VS_INCREMENTAL' WHEN k % 8 = 3 THEN 'CURRENCY_EQUIV' WHEN k % 8 = 4 THEN 'SAME_QUOTE_DIFFERENT_NUMBER' WHEN k % 8 = 5 THEN 'TEMPORAL_PROGRESSION' ELSE 'UNEXPLAINED_DISCREPANCY' END AS rule FROM @conflicts) t"""),
    ),
    "r196_no_rounding_excuse": (
        lambda s, d: rules.attribute(_conflicts(s, d).where("k % 8 = 2")).where("rule = 'UNEXPLAINED_DISCREPANCY'").select("k"),
        duck("SELECT k FROM @conflicts WHERE k % 8 = 2"),
    ),
    "r197_verdict_mapping": (
        lambda s, d: read(s, d, "events").select("event_id", rules.verdict_label(F.element_at(F.array(*[F.lit(x) for x in ("insufficient", "conflict", "restated", "corroborated", "explainable_difference", "other")]), (F.col("event_id") % 6 + 1).cast("int"))).alias("label")),
        "SELECT event_id, ['insufficient_evidence', 'true_conflict', 'explicit_correction', 'corroborated', 'caliber_explained', 'insufficient_evidence'][CAST(event_id % 6 + 1 AS INT)] AS label FROM events",
    ),
    "r198_matcher": (lambda s, d: rules.pair_batch(_groups(s, d), _matcher)[0], "SELECT o_orderkey AS group_id, CASE o_orderkey % 4 WHEN 0 THEN 'related' WHEN 1 THEN 'unrelated' ELSE 'unknown' END AS outcome FROM orders"),
    "r199_pair_batch": (lambda s, d: rules.pair_batch(_groups(s, d), _matcher)[1], "SELECT count(*) FILTER (o_orderkey % 4 = 0) AS related, count(*) FILTER (o_orderkey % 4 = 1) AS unrelated, count(*) FILTER (o_orderkey % 4 > 1) AS unknown FROM orders"),
    "r200_equity_direction": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", rules.equity_direction(F.col("o_custkey"), F.col("o_orderkey") % 1500, F.when(F.col("o_orderkey") % 2 == 0, "increase").otherwise("decrease"), F.col("o_orderkey") % 5 > 0).alias("wrong")),
        "SELECT o_orderkey, o_orderkey % 5 > 0 AND CASE WHEN o_orderkey % 2 = 0 THEN o_custkey > o_orderkey % 1500 ELSE o_custkey < o_orderkey % 1500 END AS wrong FROM orders",
    ),
    "r201_equity_findings": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", F.array_join(rules.equity_findings(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey") % 4), F.col("o_orderkey") % 4, F.col("o_orderkey") % 3 - 1, F.when(F.col("o_orderkey") % 2 == 0, "increase").otherwise("decrease"), F.col("o_custkey") % 3, F.col("o_orderkey") % 3), ",").alias("findings")),
        """SELECT o_orderkey, concat_ws(',', CASE WHEN b IS NULL THEN 'MISSING' END, CASE WHEN a > b AND o_orderkey % 2 = 1 OR a < b AND o_orderkey % 2 = 0 THEN 'DIRECTION_MISMATCH' END, CASE WHEN c < 0 THEN 'NEGATIVE_CHANGE' END, CASE WHEN c >= 0 AND c <> abs(a - b) THEN 'CHANGE_MISMATCH' END,
             CASE WHEN a = b THEN 'EQUAL_SHARES' END, CASE WHEN a = b AND r <> 0 THEN 'PASSIVE_RATIO_CHANGE' END, CASE WHEN (a - b) * r < 0 THEN 'RATIO_DIRECTION_CONFLICT' END) AS findings
           FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 4 END AS b, o_orderkey % 4 AS a, o_orderkey % 3 - 1 AS c, o_orderkey % 3 - o_custkey % 3 AS r FROM orders) t""",
    ),
    "r202_registry": (
        lambda s, d: rules.registry_issues(read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "pledge").when(F.col("o_orderkey") % 4 == 1, "equity_change").otherwise("other").alias("event_type"), F.element_at(F.array(*[F.lit(x) for x in ("direction", "pledged_ratio_this_time_of_held", "ratio_before", "no_such")]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("field"), F.when(F.col("o_custkey") % 3 > 0, "percent").otherwise("text").alias("unit"), F.lit("extracted").alias("status"), F.when(F.col("o_orderkey") % 5 > 0, "holder_shares").alias("denominator"))).select("o_orderkey", F.array_join("issues", ",").alias("issues")),
        """SELECT o_orderkey, CASE WHEN e > 1 THEN '' WHEN f = 3 OR f = 1 AND e = 1 OR f = 2 AND e = 0 THEN 'not_registered' WHEN f = 0 THEN CASE WHEN u = 'percent' THEN 'unit' ELSE '' END
             WHEN f = 1 THEN concat_ws(',', CASE WHEN u <> 'percent' THEN 'unit' END, CASE WHEN NOT h THEN 'fixed_denominator' END) ELSE concat_ws(',', CASE WHEN u <> 'percent' THEN 'unit' END, CASE WHEN NOT h THEN 'denominator_required' END) END AS issues
           FROM (SELECT o_orderkey, o_orderkey % 4 AS e, o_custkey % 4 AS f, CASE WHEN o_custkey % 3 > 0 THEN 'percent' ELSE 'text' END AS u, o_orderkey % 5 > 0 AS h FROM orders) t""",
    ),
    "r203_notice_scope": (
        lambda s, d: rules.scoped_notices(_awards(s, d), read(s, d, "orders").where("o_custkey % 3 > 0").select((F.col("o_orderkey") / 5).cast("long").alias("doc_id"), F.concat(F.lit("项目工程甲乙"), F.col("o_orderkey")).alias("project"), (F.col("o_orderkey") % 2 == 0).alias("denied"), (F.col("o_orderkey") % 6 == 0).alias("affirmed"))),
        """SELECT doc_id, project, CASE WHEN named AND o_orderkey % 6 = 0 THEN 'needs_review' WHEN named AND o_orderkey % 2 = 0 THEN 'extracted' WHEN NOT anyone AND status <> 'extracted' THEN 'not_mentioned' ELSE status END AS status,
             CASE WHEN named AND o_orderkey % 6 = 0 THEN NULL WHEN named AND o_orderkey % 2 = 0 THEN 'false' WHEN NOT anyone AND status <> 'extracted' THEN NULL ELSE value END AS value
           FROM (SELECT o_orderkey, o_orderkey // 5 AS doc_id, concat('项目工程甲乙', o_orderkey) AS project, CASE WHEN o_orderkey % 4 = 0 THEN 'not_disclosed' ELSE 'extracted' END AS status, CASE WHEN o_orderkey % 4 > 0 THEN 'true' END AS value, o_custkey % 3 > 0 AS named, bool_or(o_custkey % 3 > 0) OVER (PARTITION BY o_orderkey // 5) AS anyone FROM orders) t""",
    ),
    "r204_contract_scope": (
        lambda s, d: rules.scoped_contracts(_awards(s, d), read(s, d, "orders").where("o_orderkey % 10 = 3").select((F.col("o_orderkey") / 5).cast("long").alias("doc_id"), F.concat(F.lit("项目工程甲乙"), F.col("o_orderkey")).alias("group")), _awards(s, d).where("crc32(cast(project as binary)) % 4 > 0 or true").groupBy("doc_id").agg(F.concat_ws("，", F.collect_list("project")).alias("text"))),
        """SELECT doc_id, project, CASE WHEN st AND o_orderkey % 10 = 3 AND status = 'extracted' THEN 'needs_review' WHEN st AND o_orderkey % 10 <> 3 AND status = 'not_disclosed' THEN 'extracted' ELSE status END AS status,
             CASE WHEN st AND o_orderkey % 10 = 3 AND status = 'extracted' THEN NULL WHEN st AND o_orderkey % 10 <> 3 AND status = 'not_disclosed' THEN 'false' ELSE value END AS value
           FROM (SELECT o_orderkey, o_orderkey // 5 AS doc_id, concat('项目工程甲乙', o_orderkey) AS project, CASE WHEN o_orderkey % 4 = 0 THEN 'not_disclosed' ELSE 'extracted' END AS status, CASE WHEN o_orderkey % 4 > 0 THEN 'true' END AS value, bool_or(o_orderkey % 10 = 3) OVER (PARTITION BY o_orderkey // 5) AS st FROM orders) t""",
    ),
    "r205_name_containment": (
        lambda s, d: read(s, d, "part").select("p_partkey", rules.belongs_to(F.concat(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, "（x）").otherwise("(y)(z)"), F.lit("b")), F.element_at(F.array(F.lit("ab"), F.lit("a(z)b"), F.lit("a（x）b")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("same")),
        "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN p_partkey % 2 = 1 ELSE p_partkey % 2 = 0 END AS same FROM part",
    ),
    "r206_evidence_tiers": (
        lambda s, d: _tiers(s, d).select("l_orderkey", "l_partkey", "t.strength", "t.status"),
        """SELECT l_orderkey, l_partkey, x AS strength, CASE WHEN x IN ('none', 'conflict') THEN 'needs_review' ELSE 'extracted' END AS status FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN 'conflict' WHEN l_partkey % 2 = 0 AND l_suppkey % 2 = 0 THEN 'strong' WHEN l_partkey % 3 = 0 THEN 'medium' WHEN l_partkey % 5 = 0 THEN 'weak' ELSE 'none' END AS x FROM lineitem) t""",
    ),
    "r207_illegal_changes": (
        lambda s, d: rules.illegal_changes(read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("10").alias("value_before"), F.when(F.col("o_orderkey") % 3 == 0, "10.0").when(F.col("o_orderkey") % 3 == 1, "11").otherwise("10").alias("value_after"), F.lit("extracted").alias("status_before"), F.when(F.col("o_custkey") % 2 == 0, "needs_review").otherwise("extracted").alias("status_after"), F.element_at(F.array(F.lit("none"), F.lit("weak"), F.lit(None).cast("string")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("strength"))).select("id", F.array_join("issues", ",").alias("issues")),
        "SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 3 = 1 THEN 'VALUE_CHANGED' END, CASE WHEN o_custkey % 2 = 0 AND o_custkey % 3 > 0 THEN 'ILLEGAL_DOWNGRADE' END) AS issues FROM orders WHERE o_orderkey % 3 = 1 OR o_custkey % 2 = 0 AND o_custkey % 3 > 0",
    ),
    "r208_metric_rules": (
        lambda s, d: rules.metric_rules(read(s, d, "orders").select(F.col("o_orderkey").alias("concept"), (F.col("o_orderkey") % 3).cast("double").alias("value"), F.when(F.col("o_orderkey") % 5 == 0, 90).alias("target"), F.lit(4).alias("num"), F.when(F.col("o_orderkey") % 7 > 0, 6).alias("den")), read(s, d, "orders").select(F.col("o_orderkey").alias("concept"), (F.col("o_custkey") % 2 == 0).alias("has_target"), (F.col("o_custkey") % 3 == 0).alias("allow_difference"), (F.col("o_custkey") % 3).cast("double").alias("r_value"), (F.col("o_custkey") % 2 + 3).alias("r_num"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 2 + 5).alias("r_den"))),
        """SELECT o_orderkey AS concept, 'R1_TARGET_MISMATCH' AS rule, 'FAIL' AS status FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 5 = 0
           UNION ALL SELECT o_orderkey, 'R2_SAME_NAME_TWO_VALUES', CASE WHEN o_custkey % 3 = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders WHERE o_orderkey % 3 <> o_custkey % 3
           UNION ALL SELECT o_orderkey, r, CASE WHEN r = 'R3_OK' THEN 'PASS' ELSE 'FAIL' END FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'R3_NO_DENOMINATOR' WHEN o_custkey % 2 = 0 THEN 'R3_DENOMINATOR_DIFFERS' ELSE 'R3_OK' END AS r FROM orders WHERE o_custkey % 5 > 0) t""",
    ),
    "r209_bundle_invariants": (
        lambda s, d: rules.bundle_errors(*_bundle(s, d)),
        """SELECT o_orderkey AS case_id, u.c AS code FROM orders, (VALUES (0, 'MEMBER_LENGTH'), (1, 'MEMBER_ORDER'), (2, 'DUPLICATE_ID'), (3, 'EVIDENCE_REF_MISSING'), (4, 'CROSS_FILE_EVIDENCE'), (5, 'CONFLICT_COUNT_DRIFT'), (6, 'CROSS_EVENT_COMPARISON')) u(k, c) WHERE o_orderkey % 9 = u.k""",
    ),
    "r210_gold_audit": (
        lambda s, d: read(s, d, "documents").select("doc_id", evidence.gold_audit(F.col("lang"), F.when(F.col("doc_id") % 4 > 0, "of the"), F.col("text"), F.lit(False)).alias("verdict")),
        "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'GOLD_NO_QUOTE' WHEN coalesce(text, '') = '' OR contains(text, 'of the') OR contains(text, lang) THEN 'OK' ELSE 'GOLD_UNSUPPORTED' END AS verdict FROM documents",
    ),
    "r211_field_compare": (
        lambda s, d: gold(s, d).join(output(s, d).select(*KEY, F.col("value").alias("other")), KEY).select(*KEY, rules.values_equal("value", "other").alias("same")),
        duck("SELECT g.case_id, g.event_id, g.value IS NOT DISTINCT FROM o.value OR coalesce(abs(CAST(g.value AS DOUBLE) - CAST(o.value AS DOUBLE)) < 1e-9, false) AS same FROM @gold g JOIN @output o ON o.case_id = g.case_id AND o.event_id = g.event_id"),
    ),
    "r212_rounding_intervals": (
        lambda s, d: read(s, d, "part").select("p_partkey", rules.rounding_verdict(F.lit(12300).cast("decimal(20,6)"), (F.lit(12240) + F.col("p_partkey") % 120).cast("decimal(20,6)"), F.when(F.col("p_size") % 5 > 0, 2), F.when(F.col("p_size") % 7 > 0, 4), F.col("p_size") % 11 == 0, F.lit(False), F.when(F.col("p_size") % 13 == 0, 1)).alias("v")).select("p_partkey", "v.verdict", "v.code"),
        """SELECT p_partkey, CASE WHEN code IN ('QUALIFIED_AMOUNT_NOT_EXACT', 'ROUNDING_BOTH_SIDES_UNRESOLVED', 'ROUNDING_BASIS_UNPROVEN') THEN 'insufficient' WHEN code = 'EQUAL' THEN 'corroborated' WHEN code = 'EXPLICIT_ROUNDING' THEN 'explainable_difference' ELSE 'conflict' END AS verdict, code
           FROM (SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'QUALIFIED_AMOUNT_NOT_EXACT' WHEN p_size % 5 > 0 AND p_size % 13 = 0 THEN 'ROUNDING_BOTH_SIDES_UNRESOLVED' WHEN p_size % 5 > 0 AND p_size % 7 = 0 THEN 'ROUNDING_BASIS_UNPROVEN' WHEN p_partkey % 120 = 60 THEN 'EQUAL'
             WHEN p_size % 5 > 0 AND p_partkey % 120 >= 10 AND p_partkey % 120 < 110 THEN 'EXPLICIT_ROUNDING' ELSE 'SAME_BASIS_CONFLICT' END AS code FROM part) t""",
    ),
    "r213_swapped_sides": (
        lambda s, d: rules.swapped_alike(_conflicts(s, d).select("k", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"), F.get("quotes", F.lit(0)).alias("qa"), F.get("quotes", F.lit(1)).alias("qb"), "relation"), ["a", "qa"], ["b", "qb"], lambda df: rules.attribute(df.select("k", F.array("a", "b").alias("values"), F.array("qa", "qb").alias("quotes"), "relation")), "k"),
        "SELECT o_orderkey AS k, true AS alike FROM orders",
    ),
}


def _json(f):
    k, e = f.col("event_id"), f.concat(f.lit('"kind":"'), f.col("event_type"), f.lit('"'))
    ident = f.concat(f.lit('{"id":'), k)
    return (
        f.when(k % 8 == 1, f.concat(ident, f.lit("}")))
        .when(k % 8 == 3, f.concat(ident, f.lit(","), e, f.lit(',"note":"X"}')))
        .when(k % 8 == 4, f.concat(ident, f.lit(","), e, f.lit(',"more":1}')))
        .when(k % 8 == 5, f.concat(ident, f.lit(","), e, f.lit(',"note":"xy"}')))
        .when(k % 8 == 6, f.concat(f.lit('{"id":"'), k, f.lit('",'), e, f.lit("}")))
        .when(k % 8 == 7, f.concat(ident, f.lit(",")))
        .otherwise(f.concat(ident, f.lit(","), e, f.lit(',"note":null}')))
    )


def _log_names(s, d):
    e = read(s, d, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("session.v0"), F.col("event_id"), F.lit(".jsonl"))).when(F.col("event_id") % 5 == 0, "session.jsonl").otherwise(F.concat(F.lit("session.v"), F.col("event_id") % 5, F.lit(".jsonl")))
    return e.select(F.col("user_id").alias("session_id"), name.alias("name"))


def _evidence(s, d):
    block = F.when(F.col("doc_id") % 8 > 0, F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 10_000_000).otherwise(0))
    return read(s, d, "documents").select(F.col("doc_id").alias("item"), block.alias("block_id"), F.when(block % 9 > 0, "s").alias("snapshot"), F.col("lang").alias("quote"))


def _groups(s, d):
    return read(s, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.array(F.concat(F.lit("a"), F.col("o_orderkey")), F.concat(F.lit("b"), F.col("o_orderkey"))).alias("members"), (F.col("o_orderkey") % 2).alias("expected"))


def _results(s, d):
    return _groups(s, d).where("group_id % 5 > 0").select(F.reverse("members").alias("members"), (F.col("group_id") % 3).alias("predicted"))


def _matcher(groups):
    return groups.where("group_id % 4 < 3").select("group_id", F.when(F.col("group_id") % 4 == 0, "related").when(F.col("group_id") % 4 == 1, "unrelated").alias("outcome"))


def _tables(s, d):
    o = read(s, d, "orders").select((F.col("o_orderkey") / 8).cast("long").alias("doc_id"), (F.col("o_orderkey") % 8).alias("page"), F.col("o_custkey").alias("c"))
    pages = o.select("doc_id", "page", F.lit(800.0).alias("height"))
    at = o.select("*", F.explode(F.sequence(F.lit(0), (F.col("c") % 2).cast("int"))).alias("pos"))
    left = (F.col("c") % 5).cast("double")
    region = F.array(left, F.when(F.col("c") % 4 > 0, 50.0).otherwise(300.0), left + 400, F.when(F.col("c") % 3 > 0, 750.0).otherwise(500.0))
    return pages, at.select("doc_id", "page", "pos", F.concat(F.lit("t"), F.col("page"), F.lit("."), F.col("pos")).alias("table_id"), (F.col("c") % 2 + 3).alias("n_cols"), region.alias("region"), "c")


def _torn(s, d):
    pages, t = _tables(s, d)
    linked = tables.continued_tables(pages, t.drop("c")).drop("page")
    cols = F.explode(F.when(F.col("c") % 6 < 3, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))))
    top = t.select("doc_id", "table_id", F.lit(0).alias("row"), cols.alias("col"))
    last = t.select("doc_id", "table_id", F.lit(1).alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col"))
    cells = top.unionByName(last).withColumn("cell_id", F.concat_ws(":", "table_id", "row", "col"))
    return tables.torn_cells(cells, t, linked)


def _aligned_sides(s, d):
    g = gold(s, d).select("case_id", "event_id", (F.col("p") % 3).alias("holder"), (F.col("q") % 2).alias("direction"), F.col("q").alias("number"), "s", "p")
    o = g.where("s % 9 > 0").withColumn("holder", (F.col("p") + F.when(F.col("s") % 5 == 0, 1).otherwise(0)) % 3)
    return g, o


def _conflicts(s, d):
    c = frame(s, d, "conflicts")
    v = lambda x: F.col(x).cast("decimal(38,8)")
    three = F.col("k") % 8 == 6
    vals = F.when(three, F.array(v("v1") + v("v2"), v("v1"), v("v2")).cast("array<decimal(38,8)>")).otherwise(F.array(v("v1"), v("v2")))
    return c.select("k", vals.alias("values"), F.when(three, F.array("q1", "q2", F.lit("丙"))).otherwise(F.array("q1", "q2")).alias("quotes"), F.when(F.col("insufficient"), "unknown").otherwise("related").alias("relation"))


def _tiers(s, d):
    p, k = F.col("l_partkey"), F.col("l_suppkey")
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", rules.evidence_tier(F.when(p % 2 == 0, "cell").otherwise("paragraph"), k % 2 == 0, F.lit(True), p % 3 == 0, p % 5 == 0, p % 11 == 0).alias("t"))


def _awards(s, d):
    return read(s, d, "orders").select((F.col("o_orderkey") / 5).cast("long").alias("doc_id"), F.concat(F.lit("项目工程甲乙"), F.col("o_orderkey")).alias("project"), F.when(F.col("o_orderkey") % 4 == 0, "not_disclosed").otherwise("extracted").alias("status"), F.when(F.col("o_orderkey") % 4 > 0, "true").alias("value"))


def _bundle(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 9).alias("k"))
    ab, ba = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))
    results = o.select("case_id", ab.alias("members"), F.when(F.col("k") == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("digests"), F.when(F.col("k") == 1, ba).otherwise(ab).alias("records"), F.when(F.col("k") == 6, "unknown").otherwise("related").alias("relation"), F.when(F.col("k") == 5, 2).otherwise(1).alias("conflict_count"))
    ev = o.select("case_id", F.explode(F.when(F.col("k") == 2, F.array(F.lit("e1"), F.lit("e1"))).otherwise(F.array(F.lit("e1"), F.lit("e2")))).alias("evidence_id"), F.when(F.col("k") == 4, "z").otherwise("a").alias("member"))
    diffs = o.select("case_id", F.lit("value_conflict").alias("kind"), F.lit(True).alias("compared"), F.when(F.col("k") == 3, "e9").otherwise("e1").alias("evidence_id"))
    return results, ev, diffs


def _observed(s, d):
    c = read(s, d, "customer")
    live = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("h"), F.lit(True).alias("live"))
    kept = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).alias("h"), F.lit(False).alias("live"))
    return live.unionByName(kept).groupBy("id").agg(F.max("live").alias("live"), F.max(~F.col("live")).alias("persisted"), (F.count_distinct("h") > 1).alias("conflict"))


def _blocks(s, d):
    dot = F.when(F.col("turn") % 4 == 0, "。").otherwise("")
    return read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat(F.lit("b"), F.col("turn")).alias("block_id"), (F.floor(F.col("turn") / 3) + 1).alias("page"), F.when(F.col("turn") % 5 != 2, "paragraph").otherwise("cell").alias("kind"), F.concat(F.col("role"), dot).alias("text"))


def _outline(s, d, upto):
    """The outline of each session, folded whole or from a checkpoint of its first events."""
    log = frame(s, d, "log").select("session_id", "seq", "type", "turn", F.col("word").alias("text"))
    empty = s.createDataFrame([], projections.SAVED)
    saved = projections.replay(empty, log.where(F.col("seq") < upto), projections.OUTLINE) if upto else empty
    return projections.replay(saved, log, projections.OUTLINE).select("session_id", "version", "seq", F.sha2("state", 256).alias("state"))




def _frames(s, d):
    """Each text as two compressed frames, some with a third that is cut off, taken apart again."""

    def run(frames):
        import zstandard

        pack = zstandard.ZstdCompressor(write_checksum=True).compress
        for f in frames:
            out = []
            for conv, turn, text in zip(f["conv_id"], f["turn"], f["text"], strict=True):
                half = text.encode()[: len(text) // 2], text.encode()[len(text) // 2 :]
                data = pack(half[0]) + pack(half[1]) + (pack(b"the end")[:-3] if turn % 3 == 0 else b"")
                ends, torn = readers.frame_ends(data)
                back = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(data[a:b]) for a, b in zip([0, *ends], ends, strict=False))
                out.append((conv, turn, len(ends), torn < len(data), back == text.encode()))
            yield type(f)(out, columns=["conv_id", "turn", "frames", "torn", "whole"])

    return read(s, d, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id bigint, turn bigint, frames int, torn boolean, whole boolean")


def _envelopes(s, d):
    """One file for each nation, and one of another kind that is passed over."""
    path = scratch(s, "envelopes")
    read(s, d, "nation").select("n_nationkey", "n_name").write.option("maxRecordsPerFile", 1).json(path)
    read(s, d, "nation").select("n_name").write.mode("append").text(path)
    return readers.read_envelopes(s, path, "n_nationkey int, n_name string").select("n_nationkey", "n_name")


def _grepped(s, d):
    path = scratch(s, "lines")
    read(s, d, "conversations").select(F.translate("text", "\n\r", "  ").alias("value")).write.text(path)
    found, more = readers.search_files(s, path, "the", 10_000_000, line_bytes=1_000_000)
    return found.select("line").withColumn("more", F.lit(more))


def _events(s, d):
    kind = F.element_at(F.array(F.lit("equity_change"), F.lit("pledge"), F.lit("award_contract"), F.lit("other")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    own = F.col("o_custkey").cast("string")
    fields = F.create_map(F.lit("holder"), own, F.lit("direction"), F.col("o_orderstatus"), F.lit("shares_before"), own, F.lit("ratio_cumulative_of_held"), own, F.lit("pledged_shares_this_time"), own)
    return read(s, d, "orders").select("o_orderkey", kind.alias("event_type"), fields.alias("fields"))


def _streamed(s, d):
    """The outline of each session from a stream over files, its views written once for each batch."""
    path, out = scratch(s, "events"), scratch(s, "views")
    log = frame(s, d, "log").select("session_id", "seq", "type", "turn", F.col("word").alias("text"))
    log.where("seq < 20").coalesce(1).write.mode("append").parquet(path)
    log.where("seq >= 20").coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    views = projections.project_stream(stream, projections.OUTLINE)
    query = views.writeStream.outputMode("update").foreachBatch(projections.written_once(out)).option("checkpointLocation", scratch(s, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = s.read.parquet(out).groupBy("session_id").agg(F.max_by("view", "seq").alias("view"))
    entries = F.from_json("view", "array<struct<turn:bigint,response:string>>")
    return last.select("session_id", F.size(entries).cast("long").alias("turns"), F.size(F.filter(entries, lambda x: x["response"] != "")).cast("long").alias("answered"))
