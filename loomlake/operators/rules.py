"""Rules over facts: ordered chains where the first that applies decides, and checks that name what is broken."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``applies`` and ``decide`` are columns over the row, ``id`` names the rule in the result."""

    id: str
    applies: Column
    decide: Column


#: Fields of each event type with their unit and, for ratios, the denominator: a fixed one, or "required".
REGISTRY = (
    ("pledge", "direction", "text", None),
    ("pledge", "pledgor", "text", None),
    ("pledge", "pledgee", "text", None),
    ("pledge", "pledged_shares_this_time", "shares", None),
    ("pledge", "pledged_shares_cumulative", "shares", None),
    ("pledge", "pledged_ratio_this_time_of_held", "percent", "holder_shares"),
    ("pledge", "pledged_ratio_this_time_of_total", "percent", "total_share_capital"),
    ("pledge", "pledged_ratio_cumulative_of_held", "percent", "holder_shares"),
    ("pledge", "pledged_ratio_cumulative_of_total", "percent", "total_share_capital"),
    ("pledge", "pledge_amount", "cny", None),
    ("pledge", "start_date", "date", None),
    ("pledge", "end_date", "date", None),
    ("pledge", "purpose", "text", None),
    ("pledge", "announcement_date", "date", None),
    ("equity_change", "holder", "text", None),
    ("equity_change", "direction", "text", None),
    ("equity_change", "shares_before", "shares", None),
    ("equity_change", "shares_after", "shares", None),
    ("equity_change", "ratio_before", "percent", "required"),
    ("equity_change", "ratio_after", "percent", "required"),
    ("equity_change", "change_shares", "shares", None),
    ("equity_change", "method", "text", None),
    ("equity_change", "change_date", "date_range", None),
    ("award_contract", "bidder", "text", None),
    ("award_contract", "tenderer", "text", None),
    ("award_contract", "project_name", "text", None),
    ("award_contract", "bid_amount", "cny", None),
    ("award_contract", "currency", "text", None),
    ("award_contract", "tax_included", "text", None),
    ("award_contract", "duration", "text", None),
    ("award_contract", "consortium_members", "text", None),
    ("award_contract", "consortium_shares", "text", None),
    ("award_contract", "bid_date", "date", None),
    ("award_contract", "contract_signed", "text", None),
    ("award_contract", "formal_award_notice_received", "text", None),
    ("award_contract", "price_adjustment_status", "text", None),
    ("award_contract", "recognized_revenue", "cny", None),
)
DENOMINATORS = ("holder_shares", "total_share_capital", "net_assets", "other")
VERDICTS = {"insufficient": "insufficient_evidence", "conflict": "true_conflict", "restated": "explicit_correction", "corroborated": "corroborated", "explainable_difference": "caliber_explained"}


def chain(df: DataFrame, rules: list[Rule], default: str, out: str = "attribution") -> DataFrame:
    """``df`` with (rule, result): that of the first rule that applies; a rule whose condition is null does not."""
    picked = F.lit(None).cast("struct<rule:string,result:string>")
    for rule in reversed(rules):
        picked = F.when(F.coalesce(rule.applies, F.lit(False)), F.struct(F.lit(rule.id).alias("rule"), rule.decide.cast("string").alias("result"))).otherwise(picked)
    return df.withColumn(out, F.coalesce(picked, F.struct(F.lit(default).alias("rule"), F.lit(default).alias("result"))))


def with_plugins(df: DataFrame, plugins: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str, builtin: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(key, rule, result) by plugins first, then the built-in rules; and a trace of plugins that could not be planned.

    A plugin is a function of the rows to (key, result); what it leaves out or gives null falls through.
    """
    trace, out, rest = [], None, df
    for name, plugin in plugins:
        try:
            got = plugin(rest).select(key, F.lit(name).alias("rule"), F.col("result").cast("string").alias("result")).where("result is not null")
        except Exception as e:  # a plugin's fault must not stop the others
            trace.append(f"{name}: {type(e).__name__}")
            continue
        out = got if out is None else out.unionByName(got)
        rest = rest.join(got.select(key), key, "left_anti")
    last = builtin(rest).select(key, "rule", "result")
    return last if out is None else out.unionByName(last), trace


def adapted(df: DataFrame, plugin: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """(key, result) of a plugin that must always answer: what it leaves out, or cannot label, is insufficient evidence."""
    got = plugin(df).select(key, verdict_label(F.col("verdict")).alias("result"))
    return df.select(key).join(got, key, "left").select(key, F.coalesce("result", F.lit("insufficient_evidence")).alias("result"))


def attribution_rules(values: Column, quotes: Column, insufficient: Column) -> list[Rule]:
    """The built-in chain over the values (decimals) and quotes of a conflict, in its order of precedence.

    Nothing is explained as rounding: a small or approximate difference stays unexplained.
    """
    v = F.array_sort(values)
    low, high = F.element_at(v, 1), F.element_at(v, -1)
    total = F.aggregate(values, F.lit(0).cast("decimal(38,8)"), lambda a, x: (a + x).cast("decimal(38,8)"))
    two = F.size(values) == 2
    scale = two & (low > 0) & ((low * 10_000 == high) | (low * 100_000_000 == high))
    bare = F.transform(F.filter(quotes, lambda q: q != ""), lambda q: F.regexp_replace(q, r"(?U)\s+", ""))
    plain = F.transform(values, lambda x: F.regexp_replace(x.cast("string"), r"\.?0+$", ""))
    no_commas = F.transform(quotes, lambda q: F.regexp_replace(q, r"[,，\s]", ""))
    foreign = F.exists(quotes, lambda q: q.rlike("美元|欧元|港元|日元|外币|折合人民币"))
    across = two & (F.contains(F.get(no_commas, F.lit(1)), F.get(plain, F.lit(0))) | F.contains(F.get(no_commas, F.lit(0)), F.get(plain, F.lit(1))))
    same_quote = (F.size(bare) == F.size(values)) & (F.size(F.array_distinct(bare)) == 1) & (low != high)
    return [
        Rule("INSUFFICIENT_EVIDENCE", insufficient, F.lit("insufficient_evidence")),
        Rule("UNIT_SCALE_MISMATCH", scale, F.lit("caliber_unit_scale")),
        Rule("CUMULATIVE_VS_INCREMENTAL", (F.size(values) > 2) & (high * 2 == total), F.lit("caliber_cumulative")),
        Rule("CURRENCY_EQUIV", foreign, F.lit("caliber_currency")),
        Rule("SAME_QUOTE_DIFFERENT_NUMBER", same_quote, F.lit("true_conflict")),
        Rule("TEMPORAL_PROGRESSION", across, F.lit("temporal_progression")),
    ]


def attribute(conflicts: DataFrame) -> DataFrame:
    """``conflicts`` (values, quotes, relation) with the rule and result of the built-in chain."""
    rules = attribution_rules(F.col("values"), F.col("quotes"), F.col("relation") == "unknown")
    out = chain(conflicts, rules, "UNEXPLAINED_DISCREPANCY")
    return out.select(*conflicts.columns, "attribution.rule", "attribution.result")


def verdict_label(verdict: Column) -> Column:
    """The public label of a rule's verdict; unknown ones are insufficient."""
    names = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, verdict), F.lit("insufficient_evidence"))


def rounding_verdict(a: Column, b: Column, a_places: Column, a_scale: Column, a_qualified: Column, b_qualified: Column, b_places: Column) -> Column:
    """(verdict, code) of an exact decimal against one declared as rounded.

    ``a_places``: decimals that a declares to be rounded to, null if it declares none; ``a_scale``: powers of
    ten of the unit it is declared in, null where unproven. The interval of a rounded value is half open,
    its nearer end to zero included.
    """
    as_ = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("code"))
    half = (F.lit(5) * F.pow(F.lit(10), (a_scale - a_places - 1).cast("double"))).cast("decimal(38,12)")
    away, size = F.abs(b.cast("decimal(38,12)")), F.abs(a.cast("decimal(38,12)"))
    inside = (F.sign(a) * F.sign(b) >= 0) & (away >= size - half) & (away < size + half)
    return (
        F.when(a_qualified | b_qualified, as_("insufficient", "QUALIFIED_AMOUNT_NOT_EXACT"))
        .when(a_places.isNotNull() & b_places.isNotNull(), as_("insufficient", "ROUNDING_BOTH_SIDES_UNRESOLVED"))
        .when(a_places.isNotNull() & a_scale.isNull(), as_("insufficient", "ROUNDING_BASIS_UNPROVEN"))
        .when(a == b, as_("corroborated", "EQUAL"))
        .when(a_places.isNotNull() & inside, as_("explainable_difference", "EXPLICIT_ROUNDING"))
        .otherwise(as_("conflict", "SAME_BASIS_CONFLICT"))
    )


def equity_direction(before: Column, after: Column, direction: Column, all_extracted: Column) -> Column:
    """Whether the sign of the change contradicts the stated direction; equal sides and missing fields never do."""
    return F.coalesce(all_extracted & (((before > after) & (direction != "decrease")) | ((before < after) & (direction != "increase"))), F.lit(False))


def equity_findings(before: Column, after: Column, change: Column, direction: Column, ratio_before: Column, ratio_after: Column) -> Column:
    """The names of the findings of one equity event, in a fixed order."""
    diff, ratio = after - before, ratio_after - ratio_before
    tests = [
        ("MISSING", before.isNull() | after.isNull()),
        ("DIRECTION_MISMATCH", ((diff > 0) & (direction != "increase")) | ((diff < 0) & (direction != "decrease"))),
        ("NEGATIVE_CHANGE", change < 0),
        ("CHANGE_MISMATCH", (change >= 0) & (change != F.abs(diff))),
        ("EQUAL_SHARES", diff == 0),
        ("PASSIVE_RATIO_CHANGE", (diff == 0) & (ratio != 0)),
        ("RATIO_DIRECTION_CONFLICT", F.sign(diff) * F.sign(ratio) < 0),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))


def registry_issues(fields: DataFrame) -> DataFrame:
    """``fields`` (event_type, field, unit, status, denominator) with ``issues``; unknown event types have none.

    The registry is a table of 37 rows, the only thing that is broadcast.
    """
    spark = fields.sparkSession
    registry = spark.createDataFrame(list(REGISTRY), "event_type string, field string, want_unit string, want_denominator string")
    types = sorted({r[0] for r in REGISTRY})
    out = fields.join(F.broadcast(registry), ["event_type", "field"], "left")
    valued = F.col("status").isin("extracted", "needs_review")
    fixed = F.col("want_denominator").isNotNull() & (F.col("want_denominator") != "required")
    tests = [
        ("not_registered", F.col("want_unit").isNull()),
        ("unit", ~F.col("unit").eqNullSafe(F.col("want_unit")) & F.col("want_unit").isNotNull()),
        ("fixed_denominator", valued & fixed & ~F.col("denominator").eqNullSafe(F.col("want_denominator"))),
        ("denominator_required", valued & (F.col("want_denominator") == "required") & ~F.coalesce(F.col("denominator").isin(*DENOMINATORS), F.lit(False))),
    ]
    issues = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))
    return out.withColumn("issues", F.when(F.col("event_type").isin(*types), issues).otherwise(F.array().cast("array<string>"))).drop("want_unit", "want_denominator")


def belongs_to(project: Column, group: Column) -> Column:
    """Equal names, or equal but for one bracketed part of the project's."""
    parts = F.regexp_extract_all(project, F.lit("([（(][^（）()]*[）)])"), 1)
    return F.coalesce((project == group) | F.exists(parts, lambda p: F.concat(F.substring(project, F.lit(1), F.instr(project, p) - 1), F.substring(project, F.instr(project, p) + F.length(p), F.length(project))) == group), F.lit(False))


def scoped_contracts(awards: DataFrame, statements: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, project, status, value): signing of each award under statements that sign part of a group.

    ``statements``: (doc_id, group) of "this part is signed, the rest is not". A project of such a group
    that claims to be signed goes to review; one outside that says nothing is not signed. Only projects of
    six characters or more whose name is theirs alone and stands in the document's ``texts``.
    """
    named = awards.join(texts, "doc_id").where(F.contains("text", "project")).select("doc_id", "project").distinct()
    alone = awards.groupBy("doc_id", "project").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == 1) & (F.length("project") >= 6)).drop("n")
    hit = awards.select("doc_id", "project").distinct().join(statements, "doc_id").groupBy("doc_id", "project").agg(F.max(belongs_to(F.col("project"), F.col("group"))).alias("partial"))
    good = alone.join(named, ["doc_id", "project"], "left_semi").withColumn("usable", F.lit(True))
    out = awards.join(hit, ["doc_id", "project"], "left").join(good, ["doc_id", "project"], "left")
    use = F.coalesce(F.col("usable") & F.col("partial").isNotNull(), F.lit(False))
    review = use & F.col("partial") & (F.col("status") == "extracted") & (F.col("value") == "true")
    unsigned = use & ~F.col("partial") & F.col("status").isin("not_mentioned", "not_disclosed")
    return out.select("doc_id", "project", F.when(review, "needs_review").when(unsigned, "extracted").otherwise(F.col("status")).alias("status"), F.when(review, F.lit(None)).when(unsigned, "false").otherwise(F.col("value")).alias("value"))


def scoped_notices(awards: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, project, status, value): receipt of a notice, denied or affirmed only for projects a block names.

    ``mentions``: (doc_id, project, denied, affirmed). Both at once go to review; a denial alone is false;
    without any mention in the document an award that says nothing stays unmentioned.
    """
    per = mentions.groupBy("doc_id", "project").agg(F.max("denied").alias("denied"), F.max("affirmed").alias("affirmed"))
    docs = mentions.select("doc_id").distinct().withColumn("any", F.lit(True))
    out = awards.join(per, ["doc_id", "project"], "left").join(docs, "doc_id", "left")
    open_ = ~F.col("status").isin("unreadable", "needs_review", "not_applicable")
    denied, affirmed = F.coalesce("denied", F.lit(False)), F.coalesce("affirmed", F.lit(False))
    silent = F.col("any").isNull() & F.col("status").isin("not_disclosed", "not_mentioned")
    status = F.when(open_ & denied & affirmed, "needs_review").when(open_ & denied, "extracted").when(open_ & silent, "not_mentioned").otherwise(F.col("status"))
    value = F.when(open_ & denied & affirmed, F.lit(None)).when(open_ & denied, "false").when(open_ & silent, F.lit(None)).otherwise(F.col("value"))
    return out.select("doc_id", "project", status.alias("status"), value.alias("value"))


def evidence_tier(kind: Column, in_cell: Column, quote_in_block: Column, header: Column, hint: Column, contradicted: Column) -> Column:
    """(strength, status): strong, medium, weak, none or conflict; only the last two go to review."""
    strength = F.when(contradicted, "conflict").when((kind == "cell") & in_cell & quote_in_block, "strong").when(header, "medium").when(hint, "weak").otherwise("none")
    return F.struct(strength.alias("strength"), F.when(strength.isin("none", "conflict"), "needs_review").otherwise("extracted").alias("status"))


def illegal_changes(changes: DataFrame) -> DataFrame:
    """(id, issues) of (id, value_before, value_after, status_before, status_after, strength): VALUE_CHANGED and ILLEGAL_DOWNGRADE."""
    num = lambda c: F.expr(f"try_cast({c} AS double)")
    same = F.col("value_before").eqNullSafe(F.col("value_after")) | F.coalesce(num("value_before") == num("value_after"), F.lit(False))
    moved = F.col("status_before").isNotNull() & F.col("status_after").isNotNull() & (F.col("status_before") != F.col("status_after"))
    free = F.coalesce(F.col("strength"), F.lit("unknown")).isin("none", "conflict")
    return changes.select("id", F.array_compact(F.array(F.when(~same, F.lit("VALUE_CHANGED")), F.when(moved & ~free, F.lit("ILLEGAL_DOWNGRADE")))).alias("issues")).where(F.size("issues") > 0)


def metric_rules(cards: DataFrame, registry: DataFrame) -> DataFrame:
    """(concept, rule, status) over cards (concept, value, target, num, den) and registered metrics of one concept.

    ``registry``: (concept, has_target, allow_difference, r_value, r_num, r_den).
    """
    both = cards.join(registry, "concept")
    rows = [
        F.when(~F.col("has_target") & F.col("target").isNotNull(), F.struct(F.lit("R1_TARGET_MISMATCH").alias("rule"), F.lit("FAIL").alias("status"))),
        F.when(F.col("value") != F.col("r_value"), F.struct(F.lit("R2_SAME_NAME_TWO_VALUES").alias("rule"), F.when(F.col("allow_difference"), "PASS").otherwise("FAIL").alias("status"))),
        F.when(F.col("r_den").isNotNull() & F.col("den").isNull(), F.struct(F.lit("R3_NO_DENOMINATOR").alias("rule"), F.lit("FAIL").alias("status")))
        .when(F.col("r_den").isNull(), F.lit(None))
        .when(F.col("den") != F.col("r_den"), F.struct(F.lit("R3_DENOMINATOR_DIFFERS").alias("rule"), F.lit("FAIL").alias("status")))
        .when(F.col("num") != F.col("r_num"), F.struct(F.lit("R3_NUMERATOR_DIFFERS").alias("rule"), F.lit("FAIL").alias("status")))
        .when(F.col("den") == F.col("r_den"), F.struct(F.lit("R3_OK").alias("rule"), F.lit("PASS").alias("status"))),
    ]
    return both.select("concept", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("concept", "r.rule", "r.status")


def bundle_errors(results: DataFrame, evidence: DataFrame, differences: DataFrame) -> DataFrame:
    """(case_id, code): broken invariants of report groups.

    ``results``: (case_id, members, digests, records, relation, conflict_count), ``evidence``: (case_id,
    evidence_id, member), ``differences``: (case_id, kind, compared, evidence_id).
    """
    code = lambda df, name: df.select("case_id", F.lit(name).alias("code"))
    conflicts = differences.where("kind = 'value_conflict'").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    counted = results.join(conflicts, "case_id", "left")
    known = evidence.select("case_id", "evidence_id").distinct()
    members = results.select("case_id", F.explode("members").alias("member")).distinct()
    parts = [
        code(results.groupBy("case_id").count().where("count > 1"), "DUPLICATE_GROUP"),
        code(results.where((F.size("members") != F.size("digests")) | (F.size("members") != F.size("records"))), "MEMBER_LENGTH"),
        code(results.where((F.size("members") == F.size("records")) & (F.col("members") != F.col("records"))), "MEMBER_ORDER"),
        code(evidence.groupBy("case_id", "evidence_id").count().where("count > 1"), "DUPLICATE_ID"),
        code(differences.where("evidence_id is not null").join(known, ["case_id", "evidence_id"], "left_anti"), "EVIDENCE_REF_MISSING"),
        code(evidence.join(members, ["case_id", "member"], "left_anti"), "CROSS_FILE_EVIDENCE"),
        code(counted.where(F.col("conflict_count") != F.coalesce("n", F.lit(0))), "CONFLICT_COUNT_DRIFT"),
        code(results.where("relation <> 'related'").join(differences.where("compared"), "case_id", "left_semi"), "CROSS_EVENT_COMPARISON"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def values_equal(a: Column, b: Column) -> Column:
    """Equal texts, or numbers within 1e-9."""
    num = lambda c: F.expr(f"try_cast({c} AS double)")
    return (F.col(a).eqNullSafe(F.col(b))) | F.coalesce(F.abs(num(a) - num(b)) < 1e-9, F.lit(False))


def consistent_links(members: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(case_id, ok): a member's link names the run and schema version of its envelope."""
    out = members.join(envelopes, "case_id", "left")
    return out.select("case_id", (F.col("link_run").eqNullSafe(F.col("run_id")) & F.col("link_version").eqNullSafe(F.col("schema_version"))).alias("ok"))


def pair_batch(groups: DataFrame, matcher: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((group_id, outcome), counts): any matcher that gives related, unrelated or unknown; all three are counted."""
    judged = groups.select("group_id").join(matcher(groups).select("group_id", "outcome"), "group_id", "left").select("group_id", F.when(F.col("outcome").isin("related", "unrelated"), F.col("outcome")).otherwise("unknown").alias("outcome"))
    return judged, judged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("related", "unrelated", "unknown")])


def swapped_alike(rows: DataFrame, left: list[str], right: list[str], rule: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """(key, alike): whether a rule's result is the same when both sides are swapped, as it must be."""
    names = dict(zip([*left, *right], [*right, *left], strict=True))
    swapped = rows.select(*[F.col(names.get(c, c)).alias(c) for c in rows.columns])
    a, b = rule(rows).select(key, F.col("result").alias("one")), rule(swapped).select(key, F.col("result").alias("two"))
    return a.join(b, key).select(key, F.col("one").eqNullSafe(F.col("two")).alias("alike"))
