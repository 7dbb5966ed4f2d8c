"""Texts: cleaning, bounded cuts, previews, dates and normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as scripts see it.
BLANK = r"(?U)[\s\x{FEFF}]+"
EDGES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
TAIL = r"(?U)[\s\x{FEFF}]+$"
#: Terminal sequences and characters that no title may hold, in the order in which they go.
CONTROLS = (
    "\\x{1B}\\][^\\x{07}\\x{1B}]*(?:\\x{07}|\\x{1B}\\\\)",
    "\\x{1B}\\[[0-?]*[ -/]*[@-~]",
    "\\x{1B}[ -/]*[0-~]",
    "[\\x{00}-\\x{08}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]",
    "[\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]",
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def trim_join(parts: Column, gap: str = "\n") -> Column:
    """Parts trimmed, empty ones dropped, joined."""
    return F.array_join(F.filter(F.transform(parts, trimmed), lambda x: x != ""), gap)


def utf16_length(text: Column) -> Column:
    """Length as scripts count it: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def preview(parts: Column, limit: int) -> Column:
    """Parts joined by blanks, white space collapsed, cut to ``limit`` with an ellipsis where clipped."""
    text = trimmed(F.regexp_replace(F.array_join(parts, " "), BLANK, " "))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), TAIL, ""), F.lit("…"))
    return F.when(F.length(text) > limit - 1, cut).otherwise(text)


def clean_title(text: Column) -> Column:
    """One line without control, escape and directional characters."""
    out = text
    for pattern in CONTROLS:
        out = F.regexp_replace(out, pattern, "")
    return trimmed(F.regexp_replace(out, BLANK, " "))


def byte_cut(text: Column, most: int) -> Column:
    """The longest leading whole characters within ``most`` UTF-8 bytes."""
    if most <= 0:
        raise ValueError("most must be positive")
    # A character takes four bytes at most, so that the end is among few places.
    sizes = F.transform(F.sequence(F.lit(most // 4), F.lit(most)), lambda n: F.struct(n.alias("n"), (F.octet_length(F.substring(text, F.lit(1), n)) <= most).alias("fits")))
    last = F.aggregate(sizes, F.lit(0), lambda a, x: F.when(x["fits"], F.greatest(a, x["n"])).otherwise(a))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), last))


def title(text: Column, most: int) -> Column:
    """A clean title within ``most`` bytes."""
    return F.regexp_replace(byte_cut(clean_title(text), most), TAIL, "")


def fallback_title(text: Column, words: int, most: int) -> Column:
    """The first words of the cleaned text, within ``most`` bytes."""
    if words <= 0:
        raise ValueError("words must be positive")
    first = F.slice(F.filter(F.split(clean_title(text), " "), lambda w: w != ""), 1, words)
    return F.regexp_replace(byte_cut(F.array_join(first, " "), most), TAIL, "")


def end_slice(text: Column, n: Column | int, tail: bool = False) -> Column:
    """The first or last ``n`` code points, never half of one."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.right(text, n) if tail else F.left(text, n)


def prune(text: Column, head: int, tail: int, marker: str) -> Column:
    """Head and tail around a marker, where the text is longer than both."""
    return F.when(F.length(text) > head + tail, F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


def compact(text: Column) -> Column:
    """Without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x) for x in text], dtype=object)


def folded(text: Column) -> Column:
    """Compatibility form without white space; null is empty. ASCII texts never leave the JVM's batch."""
    return compact(_nfkc(F.coalesce(text, F.lit(""))))


def chinese_date(text: Column) -> Column:
    """``YYYY年M月D日`` as an ISO date; any other text as it is."""
    pattern = "^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日$"
    part = lambda k, n: F.lpad(F.regexp_extract(text, pattern, k), n, "0")
    return F.when(text.rlike(pattern), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))).otherwise(text)


def business_date(instant: Column, zone: str = "Asia/Shanghai") -> Column:
    """The date of an instant (UTC) in the zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def token_estimate(text: Column, per_block: int = 4) -> Column:
    """A quarter of the length, rounded up, and a constant for each block."""
    return (F.ceil(utf16_length(text) / 4) + per_block).cast("long")


def relative_time(at: Column, now: Column) -> Column:
    """(unit, count) of the time since ``at`` in milliseconds; the future counts as now."""
    ms = F.greatest(F.lit(0).cast("long"), now - at)
    out = F.struct(F.lit("now").alias("unit"), F.lit(0).cast("long").alias("count"))
    for unit, size in (("minutes", 60_000), ("hours", 3_600_000), ("days", 86_400_000), ("months", 30 * 86_400_000), ("years", 365 * 86_400_000)):
        out = F.when(ms >= size, F.struct(F.lit(unit).alias("unit"), F.floor(ms / size).cast("long").alias("count"))).otherwise(out)
    return out


def occupancy(used: Column, window: Column) -> Column:
    """Percent of a window, 100 at most; null where either side is unknown or the window is empty."""
    return F.when(used.isNotNull() & (window > 0), F.least(F.lit(100), F.round(used / window * 100))).cast("int")


def block_text(block: Column) -> Column:
    """Searchable strings of a content block (type, text, name, arguments); reasoning and unknown ones have none."""
    return F.when(block["type"] == "text", F.array(block["text"])).when(block["type"] == "tool-call", F.array(block["name"], block["arguments"])).otherwise(F.array().cast("array<string>"))


def outcome_text(kind: Column, message: Column) -> Column:
    """What the end of a turn says: errors with their message, aborts and cuts by name, success nothing."""
    return F.when(kind == "error", trim_join(F.array(F.lit("error"), F.coalesce(message, F.lit(""))))).when(kind.isin("aborted", "max-tokens", "interrupted"), kind).otherwise(F.lit(""))


def event_text(kind: Column, blocks: Column, name: Column, arguments: Column, error_name: Column, error_code: Column, reason: Column, message: Column) -> Column:
    """The semantic text of an event by its type; structural and unknown events have none."""
    content = trim_join(F.flatten(F.transform(blocks, block_text)))
    nil = F.lit("")
    return (
        F.when(kind.isin("user/message", "assistant/message"), content)
        .when(kind == "tool/call", trim_join(F.array(name, arguments)))
        .when(kind == "tool/result", trim_join(F.array(content, F.coalesce(error_name, nil), F.coalesce(error_code, nil))))
        .when(kind == "turn/end", outcome_text(reason, message))
        .otherwise(nil)
    )
