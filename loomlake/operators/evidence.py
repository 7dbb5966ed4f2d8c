"""Evidence: quotes held against the blocks, snapshots and gold that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.texts import folded

ENUMS = ("CNY", "true", "false", "increase", "decrease")


def supported(value: Column, quote: Column, text: Column, numeric: Column) -> Column:
    """Whether a text bears out a value: its quote, itself, its date in Chinese, or a form that texts never show.

    Without a text there is nothing to judge: true.
    """
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    part = lambda k: F.regexp_extract(value, iso, k).cast("int").cast("string")
    chinese = F.when(value.rlike(iso), F.concat(part(1), F.lit("年"), part(2), F.lit("月"), part(3), F.lit("日")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = yes((quote != "") & F.contains(text, quote)) | yes(F.contains(text, value)) | yes(F.contains(text, chinese)) | yes(value.isin(*ENUMS)) | yes(numeric)
    return yes(text.isNull() | (text == "")) | found


def gold_audit(value: Column, quote: Column, text: Column, numeric: Column) -> Column:
    """OK, GOLD_NO_QUOTE or GOLD_UNSUPPORTED for a gold field."""
    return F.when(F.coalesce(F.trim(quote), F.lit("")) == "", "GOLD_NO_QUOTE").when(supported(value, quote, text, numeric), "OK").otherwise("GOLD_UNSUPPORTED")


def snapshots(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """``evidence`` with ``snapshot``: by the document's digest, else by that of the parsed file."""
    by_doc = documents.where("doc_sha is not null").groupBy("doc_sha").agg(F.min("snapshot").alias("by_doc"))
    by_file = documents.groupBy("file_sha").agg(F.min("snapshot").alias("by_file"))
    out = evidence.join(by_doc, "doc_sha", "left").join(by_file, "file_sha", "left")
    return out.withColumn("snapshot", F.coalesce("by_doc", "by_file")).drop("by_doc", "by_file")


def provenance(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """``evidence`` (snapshot, block_id, quote) with ``hit`` and ``reason``.

    The quote must stand in the cited block of the snapshot, in compatibility form and without blanks;
    evidence without block, quote or snapshot is left out of hits and misses (null).
    """
    text = blocks.select("snapshot", "block_id", folded(F.col("text")).alias("in_block"))
    out = evidence.withColumn("needle", folded(F.col("quote"))).join(text, ["snapshot", "block_id"], "left")
    reason = (
        F.when(F.col("block_id").isNull() | (F.coalesce(F.trim("quote"), F.lit("")) == ""), "omit_no_block_or_quote")
        .when(F.col("snapshot").isNull(), "omit_no_snapshot")
        .when(F.col("in_block").isNull(), "block_not_found")
        .when(~F.contains("in_block", "needle"), "quote_not_in_block")
    )
    hit = F.when(reason.startswith("omit"), F.lit(None).cast("boolean")).otherwise(reason.isNull())
    return out.withColumns({"hit": hit, "reason": reason}).drop("needle", "in_block")


def provenance_summary(judged: DataFrame) -> DataFrame:
    """Totals of ``provenance``: total, hit, miss, and both reasons of omission."""
    return judged.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("miss"), F.count_if(F.col("reason") == "omit_no_snapshot").alias("omit_no_snapshot"), F.count_if(F.col("reason") == "omit_no_block_or_quote").alias("omit_no_block_or_quote"))


def index_context(cases: DataFrame, index: DataFrame) -> DataFrame:
    """(case_id, issuer, status): the issuer that lists a case; none or several mean unknown."""
    at = index.select("issuer", F.explode("cases").alias("case_id")).groupBy("case_id").agg(F.count_distinct("issuer").alias("n"), F.min("issuer").alias("issuer"))
    out = cases.select("case_id").join(at, "case_id", "left")
    return out.select("case_id", F.when(F.col("n") == 1, F.col("issuer")).alias("issuer"), F.when(F.col("n") == 1, "known").otherwise("unknown").alias("status"))


def unique_candidate(wanted: DataFrame, conflicts: DataFrame, key: list[str]) -> DataFrame:
    """(id, conflict_id): the conflict that alone agrees in all of ``key``, else null."""
    per = conflicts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("conflict_id").alias("conflict_id"))
    return wanted.join(per, key, "left").select("id", F.when(F.col("n") == 1, F.col("conflict_id")).alias("conflict_id"))


def offset_profile(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(offset, n): how far the numbers at the ends of paired block ids are apart."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9]+)$', 1) AS bigint)")
    return pairs.select((number(b) - number(a)).alias("offset")).where("offset is not null").groupBy("offset").agg(F.count(F.lit(1)).alias("n"))
