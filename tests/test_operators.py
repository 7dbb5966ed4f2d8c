"""Operators against expectations that were worked out by hand, wrong inputs and empty ones among them."""

import json

import pytest
from pyspark.sql import functions as F

from loomlake.functions import decimals, texts, values
from loomlake.operators import envelopes, evidence, filters, lineage, logs, retention, rules, scoring, search, tables
from loomlake.sources import readers, writers
from loomlake.streaming import blocks, projections


def column(spark, data, kind="string"):
    return spark.createDataFrame([(k, x) for k, x in enumerate(data)], f"k int, x {kind}")


def results(df, expression):
    return [r[0] for r in df.orderBy("k").select(expression).collect()]


def test_decimal_grammar(spark):
    cases = {"0": "0", "-0": "0", "-0.000": "0", "1.2300": "1.23", "100": "100", " 5 ": "5", "　7﻿": "7", "1e3": None, "01": None, "+1": None, "1.": None, ".5": None, "1,000": None, "": None, "9" * 120: "9" * 120, "9" * 121: None}
    assert results(column(spark, cases), decimals.parse(F.col("x"))) == list(cases.values())


def test_decimal_arithmetic_is_exact(spark):
    big = "123456789012345678901234567890.123456789"
    df = column(spark, [big, "-2.5", "1e3", None])
    assert results(df, decimals.multiply(F.col("x"), F.lit("1000.001"))) == ["123456912469134691246913469124691.346912456789", "-2500.0025", None, None]
    assert results(df, decimals.compare(F.col("x"), F.lit("-2.50"))) == [1, 0, None, None]
    assert results(column(spark, ["2.5", "-2.5", "0.4", "-0.4", "1"]), decimals.round_half_up(F.col("x"), 0)) == ["3", "-3", "0", "0", "1"]
    assert results(column(spark, ["15000", "-25000", "14999"]), decimals.round_half_up(F.col("x"), -4)) == ["20000", "-30000", "10000"]
    assert results(column(spark, ["1.25", "-0.00000001", "0.15", "0"]), decimals.shift(F.col("x"), 8)) == ["125000000", "-1", "15000000", "0"]
    with pytest.raises(ValueError):
        decimals.round_half_up(F.col("x"), 31)


def test_exact_sum(spark):
    rows = [("a", "9" * 60), ("a", "1"), ("a", "-0.001"), ("b", "1"), ("b", "x"), ("c", "-5"), ("c", "5.0")]
    df = spark.createDataFrame(rows, "g string, x string")
    got = {r.g: r.total for r in decimals.exact_sum(df, ["g"], F.col("x")).collect()}
    assert got == {"a": str(10**60 - 1) + ".999", "b": None, "c": "0"}
    assert decimals.exact_sum(df.limit(0), ["g"], F.col("x")).count() == 0


def test_measures(spark):
    def one(kind, status, raw, unit, qualifier="exact", den=None, text="text"):
        row = spark.createDataFrame([(kind, status, "single", text, raw, unit, qualifier, den, den)], "kind string, status string, scope string, text string, raw string, unit string, q string, den string, def string")
        return tuple(row.select(decimals.measure(*[F.col(c) for c in ("kind", "status", "scope", "text", "raw", "unit", "q", "den", "def")]).alias("m")).first().m)

    assert one("amount", "present", "1.25", "万元") == ("12500", "元", None)
    assert one("amount", "present", "0.15", "亿元") == ("15000000", "元", None)
    assert one("shares", "present", "-0.00000001", "亿股") == ("-1", "股", None)
    assert one("shares", "present", "1.5", "股") == (None, None, "not_whole_shares")
    assert one("ratio", "present", "5", "%") == (None, None, "denominator_required")
    assert one("ratio", "present", "5", "%", den="other") == ("5", "%", None)
    assert one("amount", "present", "5", "元", den="other") == (None, None, "denominator_not_allowed")
    assert one("amount", "explicit_zero", "0.00", "万元") == ("0", "元", None)
    assert one("amount", "present", "0", "元") == (None, None, "zero_not_declared")
    assert one("amount", "unreadable", None, None, None) == (None, "元", None)
    assert one("amount", "not_mentioned", "0", None, None) == (None, None, "missing_with_number")
    assert one("amount", "present", "1e3", "元") == one("amount", "present", "1", "股") == (None, None, "invalid_number")
    assert one("weight", "present", "1", "元") == (None, None, "invalid_kind")


def test_texts(spark):
    df = column(spark, ["a\u001b[31mred\u001b[0m\u0007  b‮", "\u001b]0;title\u0007x", "  \n ", "漢字𝕏é"])
    assert results(df, texts.clean_title(F.col("x"))) == ["ared b", "x", "", "漢字𝕏é"]
    assert results(column(spark, ["漢字𝕏é", "abc", ""]), texts.byte_cut(F.col("x"), 9)) == ["漢字", "abc", ""]
    assert results(column(spark, ["漢字𝕏é"]), texts.utf16_length(F.col("x"))) == [5]
    assert results(column(spark, ["2024年3月5日", "2024年13月", "x2024年3月5日", None]), texts.chinese_date(F.col("x"))) == ["2024-03-05", "2024年13月", "x2024年3月5日", None]
    assert results(column(spark, ["ａｂ　①", None]), texts.folded(F.col("x"))) == ["ab1", ""]
    assert results(column(spark, ["a " * 40]), texts.preview(F.array("x"), 10)) == ["a a a a a…"]
    with pytest.raises(ValueError):
        texts.byte_cut(F.col("x"), 0)


def test_ranges_and_boxes(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 5, 6, 9]), (1, [3, 2]), (2, []), (3, [4])], "k int, x array<bigint>")
    assert [[tuple(r) for r in x] for x in results(df, values.encode_ranges(F.col("x")))] == [[(1, 3), (5, None), (6, None), (9, None)], [(3, None), (2, None)], [], [(4, None)]]
    pairs = spark.createDataFrame([(0, [(1, 3), (5, None)]), (1, [(3, 1)]), (2, [(1, 3), (2, None)]), (3, [(5, None), (4, None)]), (4, [(0, 9)]), (5, [(-1, None)])], "k int, x array<struct<start:bigint,end:bigint>>")
    assert results(pairs, values.decode_ranges(F.col("x"), 5)) == [[1, 2, 3, 5], None, None, [5, 4], None, None]
    boxes = spark.createDataFrame([(0, [0.0, 0.0, 1.0, 1.0]), (1, [-1.0, 2.0, -1.0, 1.0]), (2, [0.0, None, 1.0, 1.0]), (3, None), (4, [0.0])], "k int, x array<double>")
    assert results(boxes, values.box_issue(F.col("x"))) == [[], ["negative", "left_right", "top_bottom"], ["not_a_number"], [], ["not_a_number"]]


def test_schema_subset():
    schema = {"$ref": "#/$defs/a", "$defs": {"a": {"allOf": [{"type": ["object", "null"]}], "required": ["x"], "properties": {"x": {"type": "number", "minimum": 0}, "y": {"items": {"const": [1, {"b": 2}]}, "minItems": 1, "maxItems": 2}}, "additionalProperties": {"type": "string"}}}}
    issues = lambda v: values.schema_issues(v, schema)
    assert issues({"x": 1, "y": [[1, {"b": 2.0}]], "z": "s"}) == [] and issues(None) == []
    assert sorted(issues({"x": -1, "z": 3})) == ["$.x: minimum", "$.z: type"]
    assert issues({"y": [], "x": True}) == ["$.y: minItems", "$.x: type"] and issues([]) == ["$: type"]
    assert values.schema_issues(1, {"$ref": "#/no"}) == ["$: $ref"] and values.schema_issues(1, False) == ["$: not_allowed"]


def test_surface_fold_over_replacements(spark):
    ops = [("a", 0, "append", None, None), ("a", 1, "append", None, None), ("a", 2, None, None, None), ("a", 3, "append", None, None), ("a", 4, "replace", 1, 3), ("a", 5, "replace", 0, 4), ("b", 0, "append", None, None), ("b", 1, "replace", 7, 7), ("b", 2, "append", None, None)]
    df = spark.createDataFrame(ops, "session_id string, seq bigint, op string, start bigint, end bigint")
    got = {(r.session_id, r.seq): r for r in logs.surface(df, F.col("seq") + 1).collect()}
    assert [got["a", k].surface for k in range(6)] == ["shadowed", "shadowed", "log-only", "shadowed", "shadowed", "current"]
    assert [got["a", k].replaced_by for k in range(6)] == [5, 4, None, 4, 5, None]
    assert [got["a", k].delta for k in (0, 1, 3, 4, 5)] == [1, 2, 4, 5 - 6, 6 - 6] and got["a", 5].position == 0
    assert got["b", 0].error == "replace at seq 1 has an invalid range" and got["a", 0].error is None
    chains = {r.seq: r.chain for r in logs.replacement_chain(logs.surface(df)).where("session_id = 'a'").collect()}
    assert chains == {0: [5], 1: [4, 5], 3: [4, 5], 4: [5]}


EVENTS = "session_id string, seq bigint, type string, time bigint, turn bigint, step bigint, call_id string, calls array<string>"


def test_closers(spark):
    def event(s, seq, kind, turn=1, step=None, call=None, calls=()):
        return (s, seq, kind, 1000 + seq, turn, step, call, list(calls))

    rows = [event("open", 0, "turn/start"), event("open", 1, "step/start", step=7), event("open", 2, "assistant/message", step=7, calls=["c1", "c2", "c3"]), event("open", 3, "tool/call", step=7, call="c2"), event("open", 4, "tool/result", step=7, call="c3")]
    rows += [event("done", 0, "turn/start"), event("done", 1, "assistant/message", calls=["c1"]), event("done", 2, "turn/end")]
    rows += [event("between", 0, "turn/start"), event("between", 1, "step/start", step=1), event("between", 2, "assistant/message", step=1, calls=["c1"]), event("between", 3, "step/end", step=1)]
    df = spark.createDataFrame(rows, EVENTS)
    got = [(r.session_id, r.seq, r.type, r.time, r.turn, r.step, r.call_id, r.error, r.reason) for r in logs.closers(df).orderBy("session_id", "seq").collect()]
    assert got == [
        ("between", 4, "turn/end", 1003, 1, None, None, None, "interrupted"),
        ("open", 5, "tool/result", 1004, 1, 7, "c1", "not_started", None),
        ("open", 6, "tool/result", 1004, 1, 7, "c2", "outcome_unknown", None),
        ("open", 7, "step/end", 1004, 1, 7, None, None, None),
        ("open", 8, "turn/end", 1004, 1, None, None, None, "interrupted"),
    ]
    assert logs.closers(df.limit(0)).count() == 0


def test_lineage(spark):
    rows = [(1, None, 5, "w"), (2, 1, 9, "w"), (3, 1, 4, "x"), (4, 3, 1, "w"), (5, 77, 1, "w"), (6, 5, 2, "w")]
    df = spark.createDataFrame(rows, "id int, parent int, created_at int, cwd string")
    got = {r.id: (r.ancestors, r.unresolved) for r in lineage.ancestors(df).collect()}
    assert got == {1: ([], None), 2: ([1], None), 3: ([1], None), 4: ([3, 1], None), 5: ([], 77), 6: ([5], 77)}
    order = [r.id for r in lineage.descendants(df).where("root = 1").orderBy("path").collect()]
    assert order == [3, 4, 2]
    assert sorted(r.id for r in lineage.authorised_descendants(df, "w").where("root = 1").collect()) == [2]
    with pytest.raises(lineage.LineageError):
        lineage.ancestors(spark.createDataFrame([(1, 2, 0, "w"), (2, 1, 0, "w"), (3, 1, 0, "w")], "id int, parent int, created_at int, cwd string")).collect()


def test_filters():
    for wrong in ([{"kind": "seq", "from": True}], [3], None, [{"kind": "text", "text": ""}]):
        with pytest.raises(filters.FilterError):
            filters.event_clauses(wrong)
    with pytest.raises(filters.FilterError):
        filters.session_clauses([{"kind": "parent", "values": [1]}])


def test_names_and_cursors():
    assert search.name_score("foo-bar", "fb") == (1 + 8) + (1 + 8 - 3)
    assert search.name_score("xab", "ab") == 1 - 1 + 1 + 4 and search.name_score("ba", "ab") is None
    assert search.resume(search.cursor("v", [1]), "v") == [1]


def test_retained_ends():
    assert retention.retain([("text", "a" * 40), ("image", ""), ("text", "b" * 40)], 28, image=100) == ([("text", "a" * 40)], [("text", "b" * 40)], 0, 1)
    head, tail, size, images = retention.retain([("text", "abcdefgh" * 10)], 20)
    assert head == [("text", ("abcdefgh" * 10)[:24])] and tail == [("text", ("abcdefgh" * 10)[-24:])] and size == 80 - 48 and images == 0
    assert retention.retain([], 10) == ([], [], 0, 0)


def test_alignment_tiers(spark):
    cols = "case_id string, event_id int, holder string, direction string, number int"
    gold = spark.createDataFrame([("a", 1, "x", "up", 5), ("a", 2, "y", "up", 6), ("a", 3, "z", "up", 7), ("b", 1, "x", "up", 1), ("c", 1, "x", "up", 1)], cols)
    out = spark.createDataFrame([("a", 9, "x", "up", 5), ("a", 8, "Y", "up", 6), ("a", 7, "q", "up", 99), ("b", 4, "other", "down", 2)], cols)
    found, extras = scoring.aligned(gold, out, ["holder", "direction"], ["number"])
    assert {(r.case_id, r.gold_id): (r.output_id, r.alignment) for r in found.collect()} == {("a", 1): (9, "exact_key"), ("a", 2): (8, "numeric_fallback"), ("a", 3): (None, "missing_event"), ("b", 1): (4, "single_event_fallback"), ("c", 1): (None, "missing_event")}
    assert [(r.case_id, r.output_id) for r in extras.collect()] == [("a", 7)]


def test_rounding_intervals(spark):
    def verdict(a, b, places=2, scale=4):
        df = spark.createDataFrame([(a, b)], "a string, b string").select(F.col("a").cast("decimal(30,10)").alias("a"), F.col("b").cast("decimal(30,10)").alias("b"))
        none = F.lit(None).cast("int")
        return df.select(rules.rounding_verdict(F.col("a"), F.col("b"), F.lit(places).cast("int"), F.lit(scale).cast("int"), F.lit(False), F.lit(False), none).alias("v")).first().v.code

    assert verdict("12300", "12250") == verdict("12300", "12349.9999999") == verdict("-12300", "-12250") == "EXPLICIT_ROUNDING"
    assert verdict("12300", "12350") == verdict("-12300", "-12350") == "SAME_BASIS_CONFLICT"
    assert verdict("1.23", "1.234", 2, None) == "ROUNDING_BASIS_UNPROVEN" and verdict("1000", "1001", None) == "SAME_BASIS_CONFLICT"


def test_sources_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}"
    for session, name, lines in (("s1", "session.jsonl", ['{"type":"a","seq":0,"time":1}']), ("s1", "session.v2.jsonl", ['{"type":"b","seq":0,"time":1}', "{bad"]), ("s1", "session.v02.jsonl", ["{}"]), ("s2", "notes.jsonl", ["{}"])):
        folder = tmp_path / "logs" / session
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("\n".join(lines))
    got = [(r.session_id, r.generation, r.type, r.corrupt) for r in readers.read_logs(spark, f"{path}/logs").collect()]
    assert sorted(got, key=repr) == [("s1", 2, "b", None), ("s1", 2, None, "{bad")]
    events = spark.createDataFrame([("s", 0), ("s", 1)], "session_id string, seq bigint")
    assert writers.append_batch(events, f"{path}/log") == 2
    for wrong in ([("s", 3)], [("s", 0)], [("s", 2), ("s", 2)], [("t", 1)]):
        with pytest.raises(writers.SequenceError):
            writers.append_batch(spark.createDataFrame(wrong, "session_id string, seq bigint"), f"{path}/log")
    assert spark.read.parquet(f"{path}/log").count() == 2
    with pytest.raises(ValueError):
        readers.quarantined(spark.createDataFrame([(1, True)], "k int, bad boolean"), False)
    with pytest.raises(ValueError):
        readers.frame_ends(b"not a frame")
    log = spark.createDataFrame([(k, 0) for k in ("s1", "s2", "s3")], "session_id string, seq int")
    tree = spark.createDataFrame([("s1", "s2")], "root string, id string")
    writers.export_logs(log, spark.createDataFrame([("s1",)], "id string"), tree, f"{path}/out")
    assert sorted(r.session_id for r in spark.read.parquet(f"{path}/out").collect()) == ["s1", "s2"]
    page = spark.createDataFrame([(1, "<h1>A &amp;  b</h1><p>x <b>y</b></p><p> </p><ul><li>z</li></ul>"), (2, None)], "page_id int, html string")
    assert [[tuple(b) for b in r.blocks] for r in readers.page_blocks(page).orderBy("page_id").collect()] == [[("h1", "A & b"), ("p", "x y"), ("li", "z")], []]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    path, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "session_id string, seq bigint, type string, turn bigint, text string"
    log = [("s", 0, "turn/start", 1, None), ("s", 1, "user/message", 1, "ask"), ("s", 2, "assistant/message", 1, "say"), ("s", 3, "turn/end", 1, None), ("s", 4, "turn/start", 1, None), ("s", 5, "turn/start", 2, None), ("s", 6, "user/message", 2, "x" * 80)]

    def run():
        views = projections.project_stream(spark.readStream.schema(schema).parquet(path), projections.OUTLINE)
        query = views.writeStream.outputMode("update").foreachBatch(projections.written_once(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        last = spark.read.parquet(out).orderBy(F.desc("seq")).first()
        return last.seq, json.loads(last.view)

    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put(log[:3])
    assert run() == (2, [{"turn": 1, "seq": 0, "prompt": "ask", "response": ""}])
    put(log[:5])  # delivered again, and on
    assert run()[1] == [{"turn": 1, "seq": 0, "prompt": "ask", "response": "say"}]
    put(log[5:])
    assert run() == (6, [{"turn": 1, "seq": 0, "prompt": "ask", "response": "say"}, {"turn": 2, "seq": 5, "prompt": "x" * 49 + "…", "response": ""}])

    # In batch: a saved state goes on, one of another version is folded anew.
    events = spark.createDataFrame(log, schema)
    whole = projections.replay(spark.createDataFrame([], projections.SAVED), events, projections.OUTLINE).collect()
    half = projections.replay(spark.createDataFrame([], projections.SAVED), events.where("seq < 3"), projections.OUTLINE)
    assert projections.replay(half, events, projections.OUTLINE).collect() == whole
    assert projections.replay(half.withColumn("version", F.lit(1)), events, projections.OUTLINE).collect() == whole
    assert projections.replay(half.withColumn("state", F.lit('{"turns": [], "draft": ""}')), events, projections.OUTLINE).collect() != whole


def test_blocks_of_a_broken_stream(spark):
    schema = "stream string, seq int, type string, index int, block_type string, text string, final string"
    rows = [("r", 0, "text-delta", 0, "text", "a", None), ("r", 1, "block-end", 0, "text", None, "A"), ("r", 2, "text-delta", 0, "text", "late", None), ("r", 3, "block-end", 0, "text", None, "B"), ("r", 4, "reasoning-delta", 1, "reasoning", " ", None), ("r", 5, "tool-call-delta", 2, "tool-call", "{}", None)]
    got = blocks.assembled(spark.createDataFrame(rows, schema))
    assert [(r["index"], r.type, r.text, r.closed) for r in got.orderBy("index").collect()] == [(0, "text", "A", True), (1, "reasoning", " ", False), (2, "tool-call", "{}", False)]
    assert [r["index"] for r in blocks.interrupted(got).collect()] == [0]
    end = spark.createDataFrame([("r", 9, "finish", None, None, "max-tokens", None)], schema)
    assert sorted(r["index"] for r in blocks.finished(got, end).collect()) == [0, 1]


def test_evidence_and_sides(spark):
    ev = spark.createDataFrame([("s", "b1", "ＡＢ c"), ("s", "b1", "no"), ("s", "b2", "x"), (None, "b1", "ab"), ("s", None, "ab"), ("s", "b1", " ")], "snapshot string, block_id string, quote string")
    bl = spark.createDataFrame([("s", "b1", "xx A B　Ｃc AB c")], "snapshot string, block_id string, text string")
    got = evidence.provenance(ev, bl)
    assert sorted(((r.hit, r.reason) for r in got.collect()), key=repr) == sorted([(True, None), (False, "quote_not_in_block"), (False, "block_not_found"), (None, "omit_no_snapshot"), (None, "omit_no_block_or_quote"), (None, "omit_no_block_or_quote")], key=repr)
    side = envelopes.sides(spark.createDataFrame([("pledge", {"pledgor": "p", "shares_after": "9"})], "event_type string, fields map<string,string>"))
    r = side.first()
    assert r.identity["pledgor"] == "p" and r.identity["end_date"] is None and r.observations["shares_after"].scope == "after"
    assert envelopes.as_envelope(side).first().fields == {"pledgor": "p", "shares_after": "9"}
    pages = spark.createDataFrame([("d", 1, 800.0), ("d", 2, 800.0)], "doc_id string, page int, height double")
    t = spark.createDataFrame([("d", 1, 0, "t1", 3, [10.0, 50.0, 400.0, 750.0]), ("d", 2, 0, "t2", 3, [11.5, 60.0, 401.0, 300.0])], "doc_id string, page int, pos int, table_id string, n_cols int, region array<double>")
    assert [r.continued_from for r in tables.continued_tables(pages, t).collect()] == ["t1"]
