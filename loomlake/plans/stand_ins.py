"""Tables that stand in for the reference's inputs, made from the driver's tables by fixed rules.

They are inputs, not operators, so one text in the common dialect serves both engines. All rows of the
driver's tables take part; the rules by remainders give each case that an operator must tell apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import render

STAND_INS = {
    # A session log for each user: turns of eight events, results lost now and then, an open tail.
    "log": """
        SELECT session_id, seq, CASE seq % 8 WHEN 0 THEN 'turn/start' WHEN 1 THEN 'step/start' WHEN 2 THEN 'user/message' WHEN 3 THEN 'assistant/message'
                 WHEN 4 THEN 'tool/call' WHEN 5 THEN CASE WHEN event_id % 11 = 0 THEN 'assistant/attempt' ELSE 'tool/result' END WHEN 6 THEN 'step/end' ELSE 'turn/end' END AS type,
               ms AS time, $DIV(seq, 8) AS turn, CASE WHEN seq % 8 BETWEEN 1 AND 6 THEN $DIV(seq, 8) * 10 END AS step,
               CASE WHEN seq % 8 IN (4, 5) THEN concat('c', $DIV(seq, 8)) END AS call_id, event_id, word, amount
        FROM (SELECT concat('s', user_id) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
                     event_id, $MILLIS(ts) AS ms, event_type AS word, CAST(floor(value) AS BIGINT) AS amount FROM @events) t""",
    # Operations on the surface of each session: appends, and two kinds of replacement, one over the other.
    "ops": """
        SELECT session_id, seq, CASE WHEN seq % 10 IN (4, 9) THEN 'replace' WHEN seq % 10 = 6 THEN NULL ELSE 'append' END AS op,
               CASE WHEN seq % 10 = 4 THEN seq - 2 WHEN seq % 10 = 9 THEN seq - 5 END AS first_seq, CASE WHEN seq % 10 IN (4, 9) THEN seq - 1 END AS last_seq, amount
        FROM (SELECT concat('s', user_id) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, CAST(floor(value) AS BIGINT) AS amount FROM @events) t""",
    # Sessions and their parents: a forest over orders, with parents that nobody has.
    "sessions": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 1 THEN 900000000 + o_orderkey ELSE $DIV(o_orderkey, 3) END AS parent,
               o_custkey AS created_at, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('w', o_custkey % 4) END AS cwd, o_orderkey % 2 = 0 AS live, o_orderkey % 3 = 0 AS persisted
        FROM @orders""",
    # Gold fields, and outputs that miss, flip, fill or change some of them and add others.
    "gold": """
        SELECT case_id, event_id, concat('f', p % 4) AS field,
               CASE WHEN p % 7 = 0 THEN 'not_mentioned' WHEN p % 7 = 1 THEN 'needs_review' WHEN p % 7 = 2 THEN 'unreadable' ELSE 'extracted' END AS status,
               CASE WHEN p % 7 IN (0, 2) OR p % 14 = 1 THEN NULL ELSE concat(q) END AS value,
               CASE p % 3 WHEN 0 THEN 'cny' WHEN 1 THEN 'shares' ELSE 'text' END AS unit, CASE WHEN p % 3 = 1 THEN 'holder_shares' END AS denominator, p, s, q
        FROM (SELECT l_orderkey AS case_id, l_linenumber AS event_id, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) - 20 AS q FROM @lineitem GROUP BY l_orderkey, l_linenumber) t""",
    "output": """
        SELECT case_id, event_id + CASE WHEN s % 10 = 3 THEN 100 ELSE 0 END AS event_id, concat('f', p % 4) AS field,
               CASE WHEN s % 6 = 1 THEN 'extracted' WHEN s % 6 = 2 THEN 'not_mentioned' WHEN p % 7 = 0 THEN 'not_mentioned' WHEN p % 7 = 1 THEN 'needs_review' WHEN p % 7 = 2 THEN 'unreadable' ELSE 'extracted' END AS status,
               CASE WHEN s % 6 = 2 THEN NULL WHEN s % 6 <> 1 AND (p % 7 IN (0, 2) OR p % 14 = 1) THEN NULL WHEN s % 5 = 0 THEN concat(-q) WHEN s % 5 = 1 THEN concat(q, '.0') ELSE concat(q) END AS value,
               CASE p % 3 WHEN 0 THEN 'cny' WHEN 1 THEN 'shares' ELSE 'text' END AS unit, CASE WHEN p % 3 = 1 THEN 'holder_shares' END AS denominator, s % 4 > 0 AS standardized
        FROM (SELECT l_orderkey AS case_id, l_linenumber AS event_id, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) - 20 AS q FROM @lineitem GROUP BY l_orderkey, l_linenumber) t
        WHERE s % 9 > 0""",
    # Numbers as texts: most are decimals, the others break one rule each.
    "numbers": """
        SELECT l_orderkey, l_linenumber, l_partkey, CASE l_suppkey % 9 WHEN 0 THEN '1e3' WHEN 1 THEN '007' WHEN 2 THEN '1,000' WHEN 3 THEN '-0.00' WHEN 4 THEN concat(' ', l_partkey, ' ')
                 WHEN 5 THEN concat('-', l_partkey, '.50') WHEN 6 THEN concat(l_partkey, '.') ELSE concat(l_partkey, '.', 10 + l_linenumber) END AS s FROM @lineitem""",
    # Timed spans of each user.
    "spans": """
        SELECT user_id, event_id, $MILLIS(ts) AS began, $MILLIS(ts) + CAST(floor(abs(value)) AS BIGINT) * 60000 AS ended FROM @events""",
    # Chunks of streamed replies: three blocks for each user, closed, left open, or closed twice.
    "chunks": """
        SELECT stream, seq, $DIV(seq, 6) % 3 AS idx, CASE WHEN seq % 6 = 4 THEN 'block-end' WHEN seq % 6 = 0 THEN 'block-start' ELSE 'text-delta' END AS type,
               CASE $DIV(seq, 6) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'reasoning' ELSE 'tool-call' END AS block_type,
               CASE WHEN seq % 6 IN (1, 2, 3, 5) THEN concat(word, seq, ' ') END AS text, CASE WHEN seq % 6 = 4 THEN concat('<', seq, '>') END AS final
        FROM (SELECT concat('r', user_id) AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, event_type AS word FROM @events) t
        WHERE NOT (seq % 6 = 4 AND $DIV(seq, 6) % 5 = 1)""",
    # Conflicts of two to four values with their quotes.
    "conflicts": """
        SELECT k, v1, CASE k % 8 WHEN 0 THEN v1 * 10000 WHEN 1 THEN v1 * 100000000 WHEN 2 THEN v1 + 1 ELSE v1 + 7 END AS v2, k % 8 = 7 AS insufficient,
               CASE k % 8 WHEN 3 THEN '折合人民币' WHEN 4 THEN '持 股' WHEN 5 THEN concat('由', v1 + 7, '股变为') ELSE '甲' END AS q1,
               CASE k % 8 WHEN 4 THEN '持股' WHEN 5 THEN '丁' ELSE '乙' END AS q2
        FROM (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) + 12 AS v1 FROM @orders) t""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = STAND_INS[name]
    used = sorted(set(re.findall(r"@(\w+)", text)))
    sql = render(re.sub(r"@(\w+)", r"{\1}", text), duckdb=False)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(body: str) -> str:
    """DuckDB SQL of ``body`` over the stand-ins that it names as @name."""
    used = [n for n in STAND_INS if re.search(rf"@{n}\b", body)]
    ctes = ", ".join(f"{n} AS ({render(STAND_INS[n].replace('@', ''), duckdb=True)})" for n in used)
    body = body.replace("@", "")
    if not used:
        return body
    return f"WITH RECURSIVE {ctes}" + (f", {body.lstrip()[5:].lstrip()}" if body.lstrip().upper().startswith("WITH ") else f" {body}")
