"""Comparison of facts with gold: (case_id, key, field, status, value, unit, ...), one row for each field.

Missing rows stay in the denominator; a rate over nothing is null. All joins are equi joins on the case
and key; counters are conditional sums that combine before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EMPTY = ("not_mentioned", "not_disclosed", "not_applicable", "unreadable")
STATUSES = ("extracted", "not_disclosed", "not_applicable", "not_mentioned", "unreadable", "needs_review")
STRENGTHS = ("strong", "medium", "weak", "none", "conflict", "unknown")
NUMERIC = ("cny", "shares", "percent")


def metric(n: Column, d: Column) -> Column:
    """(numerator, denominator, rate); the rate over nothing is null."""
    return F.struct(n.alias("numerator"), d.alias("denominator"), F.try_divide(n.cast("double"), d).alias("rate"))


def key_conflicts(events: DataFrame, key: list[str]) -> DataFrame:
    """(*key, n): keys that several events share."""
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(gold: DataFrame, output: DataFrame, key: list[str]) -> DataFrame:
    """(*key, field, verdict, gold_status, output_status): both, miss or extra for each field that a side extracts.

    Rows are fields; of keys that collide, all fields are compared. An event that one side lacks gives a
    miss or an extra for each of its extracted fields.
    """
    g = gold.select(*key, "field", F.col("status").alias("gold_status"))
    o = output.select(*key, "field", F.col("status").alias("output_status"))
    out = g.join(o, [*key, "field"], "full_outer")
    has = lambda c: F.coalesce(F.col(c) == "extracted", F.lit(False))
    verdict = F.when(has("gold_status") & has("output_status"), "both").when(has("gold_status"), "miss").when(has("output_status"), "extra")
    return out.withColumn("verdict", verdict).where("verdict is not null").select(*key, "field", "verdict", "gold_status", "output_status")


def paired_runs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(*key, side): events of two runs by natural key, on both sides or one."""
    sides = a.select(*key, F.lit(True).alias("in_a")).join(b.select(*key, F.lit(True).alias("in_b")), key, "full_outer")
    return sides.select(*key, F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b").alias("side"))


def run_counters(a: DataFrame, b: DataFrame, doc: str, key: list[str]) -> DataFrame:
    """(docs, business_identical, value_slots, value_slots_differ, null_status_flips) of two runs.

    ``a`` and ``b``: (doc, *key, field, value, status). Documents of one run alone do not count; an event
    that one run lacks makes its document differ.
    """
    on = [doc, *key, "field"]
    both = a.select(doc).distinct().join(b.select(doc).distinct(), doc)
    x = a.select(*on, F.col("value").alias("va"), F.col("status").alias("sa"), F.lit(True).alias("ina"))
    y = b.select(*on, F.col("value").alias("vb"), F.col("status").alias("sb"), F.lit(True).alias("inb"))
    ev = paired_runs(a.select(doc, *key).distinct(), b.select(doc, *key).distinct(), [doc, *key])
    rows = x.join(y, on, "full_outer").join(ev, [doc, *key]).join(both, doc, "left_semi")
    paired = F.col("side") == "both"
    valued = paired & (F.col("va").isNotNull() | F.col("vb").isNotNull())
    differs = valued & ~F.col("va").eqNullSafe(F.col("vb"))
    flips = paired & ~F.col("sa").eqNullSafe(F.col("sb"))
    n = lambda c: F.count_if(c).alias
    per_doc = rows.groupBy(doc).agg(n(valued)("slots"), n(differs)("differ"), n(flips & F.col("va").isNull() & F.col("vb").isNull())("null_flips"), (F.count_if(differs | flips | ~paired) == 0).alias("same"))
    return per_doc.agg(F.count(F.lit(1)).alias("docs"), F.count_if("same").alias("business_identical"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(o) for c, o in (("slots", "value_slots"), ("differ", "value_slots_differ"), ("null_flips", "null_status_flips"))])


def aligned(gold: DataFrame, output: DataFrame, strict: list[str], numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """((case_id, gold_id, output_id, alignment), extras): each event of gold with at most one of the output.

    First by the strict key (null equals null; several pair in order), then the only event of both sides of a case, then a
    numeric key that one left-over output alone has. Each output is used once; the rest are extras.
    """
    def tagged(df: DataFrame, ident: str, key: list[str], text: str) -> DataFrame:
        k = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
        rn = F.row_number().over(Window.partitionBy("case_id", "k").orderBy(ident))
        return df.select("case_id", ident, k.alias("k")).withColumn("rn", rn).withColumnRenamed("k", text)

    a = tagged(gold.withColumnRenamed("event_id", "gold_id"), "gold_id", strict, "k")
    b = tagged(output.withColumnRenamed("event_id", "output_id"), "output_id", strict, "k")
    exact = a.join(b, ["case_id", "k", "rn"]).select("case_id", "gold_id", "output_id", F.lit("exact_key").alias("alignment"))
    left = gold.withColumnRenamed("event_id", "gold_id").join(exact, ["case_id", "gold_id"], "left_anti")
    free = output.withColumnRenamed("event_id", "output_id").join(exact, ["case_id", "output_id"], "left_anti")
    ones = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").join(output.groupBy("case_id").agg(F.count(F.lit(1)).alias("m")).where("m = 1"), "case_id").select("case_id")
    single = left.select("case_id", "gold_id").join(free.select("case_id", "output_id"), "case_id").join(ones, "case_id", "left_semi").withColumn("alignment", F.lit("single_event_fallback"))
    left, free = left.join(single, ["case_id", "gold_id"], "left_anti"), free.join(single, ["case_id", "output_id"], "left_anti")
    x = tagged(left, "gold_id", numeric, "k").where("rn = 1").drop("rn")
    y = tagged(free, "output_id", numeric, "k")
    alone = y.groupBy("case_id", "k").agg(F.count(F.lit(1)).alias("n"), F.first("output_id").alias("output_id")).where("n = 1").drop("n")
    by_number = x.join(alone, ["case_id", "k"]).select("case_id", "gold_id", "output_id", F.lit("numeric_fallback").alias("alignment"))
    found = exact.unionByName(single.select(*exact.columns)).unionByName(by_number)
    missing = gold.select("case_id", F.col("event_id").alias("gold_id")).join(found, ["case_id", "gold_id"], "left_anti").select("case_id", "gold_id", F.lit(None).cast(dict(found.dtypes)["output_id"]).alias("output_id"), F.lit("missing_event").alias("alignment"))
    extras = output.select("case_id", F.col("event_id").alias("output_id")).join(found, ["case_id", "output_id"], "left_anti")
    return found.unionByName(missing), extras


def has_value(status: Column, value: Column) -> Column:
    """Extracted, or under review with a value."""
    return F.coalesce((status == "extracted") | ((status == "needs_review") & value.isNotNull()), F.lit(False))


def field_verdict(gs: Column, gv: Column, us: Column, uv: Column, absolute: Column) -> Column:
    """The difference of a field from gold, null where they agree; ``us`` null means that the field is missing.

    ``absolute`` fields compare without their sign.
    """
    g, u = has_value(gs, gv), has_value(us, uv)
    plain = lambda v: F.when(absolute, F.regexp_replace(v, "^-", "")).otherwise(v)
    return (
        F.when(us.isNull(), "MISSING_FIELD")
        .when((gs != us) & g & ~u, "MISSING_VALUE")
        .when((gs != us) & ~g & u, "WRONG_FILLED")
        .when(gs != us, "STATUS_DIFF")
        .when(g & ~plain(gv).eqNullSafe(plain(uv)), "VALUE_DIFF")
    )


def plain_number(value: Column) -> Column:
    """A value without blanks and commas, as a double where it is a number, else null."""
    return F.try_to_number(F.regexp_replace(value, r"(?U)[\s,，]", ""), F.lit("S9999999999999999.99999999")).cast("double")


def held_out(cases: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """(case_id, n, verdict): a case selects exactly one event by all its key fields, whose value must agree.

    Values agree as numbers where both are, else as texts without blanks and commas.
    """
    found = cases.join(events, key, "left")
    bare = lambda c: F.regexp_replace(F.col(c), r"(?U)[\s,，]", "")
    num = lambda c: F.expr(f"try_cast(regexp_replace({c}, '(?U)[\\\\s,，]', '') AS double)")
    same = F.when(num("expected").isNotNull() & num("value").isNotNull(), num("expected") == num("value")).otherwise(bare("expected") == bare("value"))
    per = found.groupBy("case_id").agg(F.count("event_id").alias("n"), F.max(F.coalesce(same, F.lit(False))).alias("same"))
    return per.select("case_id", "n", F.when(F.col("n") != 1, "not_unique").when(F.col("same"), "match").otherwise("mismatch").alias("verdict"))


def equivalent(name: Column, status: Column, unit: Column, denominator: Column, value: Column, status2: Column, unit2: Column, denominator2: Column, value2: Column, booleans: tuple[str, ...] = ()) -> Column:
    """Whether two field values are the same: status, unit and denominator, and the value as its unit reads it."""
    from loomlake.functions.decimals import parse

    basis = status.eqNullSafe(status2) & unit.eqNullSafe(unit2) & denominator.eqNullSafe(denominator2)
    number = F.coalesce(parse(value) == parse(value2), F.lit(False))
    text = F.when(name.isin(*booleans), F.lower(value).eqNullSafe(F.lower(value2))) if booleans else F.when(F.lit(False), F.lit(False))
    return basis & F.when(unit.isin(*NUMERIC), number).otherwise(text.otherwise(value.eqNullSafe(value2)))


def sample_summary(gold: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """One row of counters and metrics over gold fields, those without output included.

    Both: (*key, field, status, value, unit, denominator, standardized).
    """
    a = actual.select(*key, "field", *[F.col(c).alias(f"a_{c}") for c in ("status", "value", "unit", "denominator", "standardized")])
    rows = gold.join(a, [*key, "field"], "left")
    c = F.col
    valued = (c("status") == "extracted") & c("value").isNotNull()
    hit = valued & F.coalesce(equivalent(c("field"), c("status"), c("unit"), c("denominator"), c("value"), c("a_status"), c("a_unit"), c("a_denominator"), c("a_value")), F.lit(False))
    numeric = valued & c("unit").isin(*NUMERIC)
    attempt = numeric & F.coalesce((c("a_status") == "extracted") & c("a_value").isNotNull(), F.lit(False))
    normal = attempt & c("a_unit").eqNullSafe(c("unit")) & c("a_denominator").eqNullSafe(c("denominator")) & F.coalesce(c("a_standardized"), F.lit(False))
    empty = c("status").isin(*EMPTY)
    wrong = empty & c("a_value").isNotNull()
    old = c("status").isin("not_mentioned", "unreadable")
    n = lambda x, name: F.count_if(x).alias(name)
    out = rows.agg(n(valued, "fields"), n(hit, "hits"), n(numeric, "numeric_fields"), n(attempt, "attempted"), n(normal, "normalized"), n(empty, "empty"), n(wrong, "wrong_fill"), n(old, "legacy_empty"), n(old & c("a_value").isNotNull(), "legacy_wrong_fill"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.withColumns({"agreement": rate("hits", "fields"), "end_to_end": rate("normalized", "numeric_fields"), "conditional": rate("normalized", "attempted"), "wrong_fill_rate": rate("wrong_fill", "empty")})


def histogram(df: DataFrame, column: str, domain) -> DataFrame:
    """(value, n): a row for each value of a fixed domain, zeros included; values outside it are not counted."""
    spark = df.sparkSession
    base = spark.createDataFrame([(d,) for d in domain], "value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cohort_counts(samples: DataFrame, cohorts, executions) -> DataFrame:
    """(cohort, total, one column for each execution): cohorts without rows stand there with zeros."""
    spark = samples.sparkSession
    base = spark.createDataFrame([(c,) for c in cohorts], "cohort string")
    counts = samples.groupBy("cohort").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("execution") == e).alias(e) for e in executions])
    return base.join(counts, "cohort", "left").select("cohort", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", *executions)])


def standardisation(fields: DataFrame) -> DataFrame:
    """Counts of valued, abstained, textual and standardised fields, percentages, and how many break a rule."""
    valued = F.col("value").isNotNull()
    text = valued & (F.col("unit") == "text")
    other = valued & (F.col("unit") != "text")
    good = F.coalesce(F.col("standardized"), F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    out = fields.agg(n(valued, "valued"), n(~valued, "abstained"), n(text, "text"), n(other, "non_text"), n(other & good, "standardized"), n(~valued & good, "violations"))
    return out.withColumns({"share": F.try_divide(F.col("standardized") * 100.0, F.col("non_text")), "share_valued": F.try_divide(F.col("valued") * 100.0, F.col("valued") + F.col("abstained"))})


def status_map(fields: DataFrame, run: str) -> DataFrame:
    """(run, counts): one map of status counts for each run."""
    counts = fields.groupBy(run, "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))


def expectations(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, status): MATCH, MISMATCH, NOT_RUN, or NO_EXPECTATION for results that nobody asked for."""
    e = expected.select(key, F.col("expected"), F.lit(True).alias("asked"))
    r = results.select(key, F.col("predicted"), F.lit(True).alias("ran"))
    status = F.when(F.col("asked").isNull() | F.col("expected").isNull(), "NO_EXPECTATION").when(F.col("ran").isNull(), "NOT_RUN").when(F.col("expected").eqNullSafe(F.col("predicted")), "MATCH").otherwise("MISMATCH")
    return e.join(r, key, "full_outer").select(key, status.alias("status"))


def missing_parts(cases: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, missing): the sorted names of the parts that have no row for a case."""
    out = cases.select(key).distinct()
    for name, frame in parts.items():
        out = out.join(frame.select(key, F.lit(True).alias(name)).distinct(), key, "left")
    return out.select(key, F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in sorted(parts)])).alias("missing"))


def pair_key(members: Column) -> Column:
    """The same key for members in any order."""
    return F.array_join(F.array_sort(members), "|")


def pair_scores(groups: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """(group_id, verdict): pass, fail or not_run (a fail where strict) of each group by its unordered members."""
    g = groups.select("group_id", "expected", pair_key(F.col("members")).alias("k"))
    r = results.select("predicted", pair_key(F.col("members")).alias("k")).groupBy("k").agg(F.min("predicted").alias("predicted"))
    verdict = F.when(F.col("predicted").isNull(), "fail" if strict else "not_run").when(F.col("predicted") == F.col("expected"), "pass").otherwise("fail")
    return g.join(r, "k", "left").select("group_id", verdict.alias("verdict"))


def all_linked(members: Column, links: Column) -> Column:
    """Every member has some link with a run, a version, and no mock."""
    good = lambda link, m: (link["case_id"] == m) & link["run_id"].isNotNull() & link["version"].isNotNull() & ~link["mock"]
    return F.forall(members, lambda m: F.exists(links, lambda x: F.coalesce(good(x, m), F.lit(False))))


def sha_then_id(docs: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(doc_id, envelope, matched_by): the envelope of a document by its digest, else by its case."""
    by_sha = envelopes.where("sha is not null").groupBy("sha").agg(F.min("envelope").alias("by_sha"))
    by_case = envelopes.groupBy("case_id").agg(F.min("envelope").alias("by_case"))
    out = docs.join(by_sha, "sha", "left").join(by_case, "case_id", "left")
    return out.select("doc_id", F.coalesce("by_sha", "by_case").alias("envelope"), F.when(F.col("by_sha").isNotNull(), "sha").when(F.col("by_case").isNotNull(), "case_id").otherwise("none").alias("matched_by"))


def loose_pairs(a: DataFrame, b: DataFrame, group: list[str], order: str) -> DataFrame:
    """(*group, ordinal, a_id, b_id): the n-th of each group on both sides, whatever their ids."""
    at = lambda df, name: df.select(*group, F.row_number().over(Window.partitionBy(*group).orderBy(order)).alias("ordinal"), F.col("id").alias(name))
    return at(a, "a_id").join(at(b, "b_id"), [*group, "ordinal"], "full_outer")
