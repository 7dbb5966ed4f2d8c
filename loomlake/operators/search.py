"""Search over texts: an inverted index that is built once, best matches, pages, cursors, names by rank."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def build_index(docs: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(term, *key, tf): lower-case words of letters and digits with their counts. Write it by term to use it again."""
    terms = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return docs.select(*key, terms.alias("term")).groupBy("term", *key).agg(F.count(F.lit(1)).alias("tf"))


def update_index(index: DataFrame, digests: DataFrame, docs: DataFrame, key: list[str], text: Column) -> tuple[DataFrame, DataFrame]:
    """The index and digests (*key, digest) after ``docs``: unchanged documents keep their rows, unseen ones leave."""
    now = docs.select(*key, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest"))
    same = now.join(digests, [*key, "digest"], "left_semi").select(*key)
    fresh = docs.join(same, key, "left_anti")
    return index.join(same, key, "left_semi").unionByName(build_index(fresh, key, text)), now


def match_all(index: DataFrame, key: list[str], query: str) -> DataFrame:
    """(*key, score): documents that hold every term of the query; no term means no document."""
    terms = sorted({t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    found = index.where(F.col("term").isin(terms)) if terms else index.where(F.lit(False))
    return found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("tf").cast("long").alias("score")).where(F.col("n") == len(terms)).drop("n")


def contains_terms(text: Column, query: str) -> Column:
    """Every blank-separated term of the query occurs, in any case; an empty query accepts all."""
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.coalesce(F.contains(F.lower(text), F.lit(term)), F.lit(False))
    return out


def best_per_group(hits: DataFrame, group: list[str], score: str, tie: list[str]) -> DataFrame:
    """One hit of each group: the highest score, then the least tie key."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *tie))
    return hits.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def capped(rows: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows, and whether there are more."""
    some = rows.orderBy(*order).limit(most + 1)
    return some.limit(most), some.count() > most


def page(rows: DataFrame, position: str, ident: str, limit: int, before=None) -> tuple[DataFrame, object, str | None]:
    """(rows newest first, the id to go on before, code): ``limit`` rows older than the row of id ``before``.

    The id is null where no older rows exist; an unknown cursor is the code ``cursor_not_found``.
    """
    if before is not None:
        at = rows.where(F.col(ident) == F.lit(before)).select(position).limit(1).collect()
        if not at:
            return rows.limit(0), None, "cursor_not_found"
        rows = rows.where(F.col(position) < at[0][0])
    some = rows.orderBy(F.desc(position)).limit(limit + 1)
    heads = some.select(ident).collect()
    return some.limit(limit), heads[limit - 1][0] if len(heads) > limit else None, None


def cursor(version: str, last: list) -> str:
    """An opaque token of a snapshot's version and the last key that was given out."""
    return base64.urlsafe_b64encode(json.dumps([version, last], separators=(",", ":")).encode()).decode()


def resume(token: str, version: str) -> list:
    """The last key of a token; ValueError where the token is no cursor or the history has changed since."""
    try:
        made, last = json.loads(base64.urlsafe_b64decode(token.encode()))
    except Exception as e:
        raise ValueError("not a cursor") from e
    if made != version:
        raise ValueError("stale cursor")
    return last


def name_score(name: str, query: str) -> int | None:
    """The strongest alignment of the query as a subsequence of the name; null if it is none.

    A matched character earns 1, eight more at the start of a word (after - or _), four more next to the
    one before; characters skipped before or between cost one each.
    """
    best = {-1: 0}  # place of the last match: score so far
    for k, wanted in enumerate(query):
        now: dict[int, int] = {}
        for at, c in enumerate(name):
            if c != wanted:
                continue
            own = 1 + (8 if at == 0 or name[at - 1] in "-_" else 0)
            options = [s - at if k == 0 else s + 4 if before == at - 1 else s - (at - before - 1) for before, s in best.items() if before < at]
            if options:
                now[at] = max(options) + own
        best = now
    return max(best.values(), default=None)


def rank_names(items: DataFrame, query: str, name: str, label: str | None = None, position: str = "pos") -> DataFrame:
    """Items that the query matches, with ``prefix``, ``score`` and ``rank``: prefixes, then score, then position."""
    q = query.lower()

    @F.pandas_udf(T.IntegerType())
    def score(names: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else name_score(x.lower(), q) for x in names], dtype="Int32")

    keys = [name] + ([label] if label else [])
    scores = [score(F.col(k)) for k in keys]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    prefix = F.lit(False)
    for k, s in zip(keys, scores, strict=True):
        prefix = prefix | F.coalesce(F.lower(F.col(k)).startswith(q) & s.isNotNull(), F.lit(False))
    found = items.withColumns({"score": best, "prefix": prefix}).where("score is not null") if q else items.withColumns({"score": F.lit(0), "prefix": F.lit(True)})
    return found.orderBy(F.desc("prefix"), F.desc("score"), position)


def render_hits(hits: DataFrame, order: list[str]) -> DataFrame:
    """One numbered line for each hit (id, parent, available, seq, text)."""
    shown = hits.withColumn("_n", F.struct(*order))
    line = F.format_string("%s | parent %s | %s | #%d %s", F.col("id").cast("string"), F.coalesce(F.col("parent").cast("string"), F.lit("-")), F.when(F.col("available"), "available").otherwise("unavailable"), F.col("seq"), F.col("text"))
    return shown.select("id", line.alias("line"))


def render_window(rows: DataFrame, target: Column) -> DataFrame:
    """The target as JSON, its neighbours as text."""
    body = F.to_json(F.struct("seq", "type", "text"))
    return rows.withColumn("line", F.when(target, body).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit(" "), F.col("type"), F.lit(": "), F.col("text"))))
