"""Licence scans: canonical texts, looked up by digest among known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS
from .util import col, fresh

#: A line that names a holder, with or without a year, and how such a line of a licence's own text goes on.
HOLDER_LINE = r"^(portions )?(c )?copyright( |$)|^(copyright|c)( c)?( by)? ?(\d{4}|year|yyyy)|^all rights reserved$"
TEXT_LINE = r"^(portions )?(c )?copyright (holders?|notices?|owners?|laws?|licen[cs]es?|licensed|statements?|interests?|treaty|protection|and|or|in|is|to|of|on|for|as|may)( |$)"


def canonical_lines(text: Column) -> Column:
    """Lower case, letters and digits only, one spelling, single blanks, no copyright or empty lines."""
    x = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("©"), F.lit(" copyright "))
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        x = F.regexp_replace(x, rf"\b{old}\b", new)
    lines = F.transform(F.split(x, "\n"), lambda s: F.trim(s))
    return F.filter(lines, lambda s: (s != "") & (~s.rlike(HOLDER_LINE) | s.rlike(TEXT_LINE)))


def digest(lines: Column) -> Column:
    return F.sha2(F.encode(F.array_join(lines, " "), "UTF-8"), 256)


def known_digests(spark: SparkSession, texts: dict[str, str]) -> list[tuple[str, str]]:
    """(digest, id) of each known text; as many rows as the fixed table has."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("text")) for k, v in texts.items()]))
    table = spark.range(1).select(rows.alias("r")).select("r.id", digest(canonical_lines(F.col("r.text"))).alias("d"))
    return sorted((r["d"], r["id"]) for r in table.collect())


def scan_licenses(docs: DataFrame, text_col: str = "text", texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``license_digest``, ``license_id`` (null if unknown) and ``notice_ids`` (array of string).

    ``license_id``: the known licence whose canonical text is the whole canonical text of the row.
    ``notice_ids``: for lines that are, as a whole, a known one-line grant; distinct, sorted.
    Defined cases: null and empty texts have the digest of the empty text and match nothing; texts
    of any length are taken whole; each row is looked up alone, so ties and repeated rows all match;
    an empty table gives no rows; columns named like the outputs are replaced, all others stay. The
    known digests are a fixed table of a few rows, the only thing that is broadcast.
    """
    spark = docs.sparkSession
    docs = docs.drop("license_digest", "license_id", "notice_ids")
    lines, d, i = fresh(docs, "lines", "digest", "id")
    known = known_digests(spark, TEXTS) + list(DIGESTS) if texts is None else known_digests(spark, texts)
    grants = known_digests(spark, NOTICES if notices is None else notices)
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias(d), F.lit(b).alias(i)) for a, b in known])).alias("r")).select(f"r.{d}", f"r.{i}")
    by_line = F.create_map(*[F.lit(x) for pair in grants for x in pair])
    one = docs.withColumn(lines, canonical_lines(col(text_col)))
    ids = F.array_compact(F.transform(lines, lambda s: F.try_element_at(by_line, F.sha2(F.encode(s, "UTF-8"), 256))))
    two = one.withColumns({d: digest(F.col(lines)), "notice_ids": F.array_sort(F.array_distinct(ids))})
    found = two.join(F.broadcast(table), d, "left")
    return found.select(*[col(c) for c in docs.columns], F.col(d).alias("license_digest"), F.col(i).alias("license_id"), "notice_ids")
