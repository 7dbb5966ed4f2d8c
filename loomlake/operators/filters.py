"""Filter clauses over sessions and event documents: validated, then compiled to one predicate.

Clauses are dicts with a ``kind``; values within a clause are alternatives, clauses must all hold. The
predicates are plain column expressions, so that scans push them down.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURFACES = ("current", "shadowed", "log-only")
AVAILABILITY = ("live", "persisted")


class FilterError(ValueError):
    """A clause that cannot be used."""


def _strings(kind: str, values, nulls: bool) -> list:
    if not isinstance(values, (list, tuple)) or any(not (isinstance(v, str) or nulls and v is None) for v in values):
        raise FilterError(f"{kind} filter values must be strings" + " or null" * nulls)
    return list(values)


def _allowed(kind: str, values: list, allowed: tuple) -> list:
    for v in values:
        if v not in allowed:
            raise FilterError(f"{kind} filter has the unknown value {v!r}")
    return values


def _range(kind: str, clause: dict) -> dict:
    out = {k: clause[k] for k in ("from", "to") if clause.get(k) is not None}
    for k, v in out.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            raise FilterError(f"{kind} filter: {k} must be finite")
    if len(out) == 2 and out["from"] > out["to"]:
        raise FilterError(f"{kind} filter: from must not be above to")
    return out


def _clauses(clauses, kinds: dict) -> list[dict]:
    if not isinstance(clauses, (list, tuple)):
        raise FilterError("filters must be a list")
    out = []
    for c in clauses:
        kind = c.get("kind") if isinstance(c, dict) else None
        if kind not in kinds:
            raise FilterError(f"unknown filter kind {kind!r}")
        out.append({"kind": kind, **kinds[kind](kind, c)})
    return out


def session_clauses(clauses) -> list[dict]:
    """Checked copies of session clauses; FilterError for a wrong one."""
    some = lambda nulls: lambda kind, c: {"values": _strings(kind, c.get("values"), nulls)}
    return _clauses(clauses, {"id": some(False), "cwd": some(True), "parent": some(True), "created-at": _range, "availability": lambda kind, c: {"values": _allowed(kind, _strings(kind, c.get("values"), False), AVAILABILITY)}})


def event_clauses(clauses) -> list[dict]:
    """Checked copies of event clauses; FilterError for a wrong one."""
    def text(kind, c):
        if not isinstance(c.get("text"), str):
            raise FilterError("text filter text must be a string")
        text_pattern(c["text"])
        return {"text": c["text"]}

    return _clauses(clauses, {"seq": _range, "time": _range, "type": lambda kind, c: {"values": _strings(kind, c.get("values"), False)}, "surface": lambda kind, c: {"values": _allowed(kind, _strings(kind, c.get("values"), False), SURFACES)}, "text": text})


def text_pattern(text: str) -> str:
    """A pattern of the literal text, in any case, whatever white space is between its words."""
    words = text.split()
    if not words:
        raise FilterError("text filter must hold more than white space")
    return "(?iu)" + r"(?U:\s+)".join(re.sub(r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\\1", w) for w in words)


def one_of(column: Column, values: list) -> Column:
    """Membership with null as a value like any other."""
    found = column.isin(*[v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    return F.coalesce(found, F.lit(False)) | column.isNull() if None in values else F.coalesce(found, F.lit(False))


def in_range(column: Column, clause: dict) -> Column:
    """Inclusive bounds, either of which may be missing."""
    out = F.lit(True)
    if "from" in clause:
        out = out & (column >= F.lit(clause["from"]))
    return out & (column <= F.lit(clause["to"])) if "to" in clause else out


def session_predicate(clause: dict) -> Column:
    """One clause over (id, cwd, parent, created_at, live, persisted)."""
    kind = clause["kind"]
    if kind == "created-at":
        return in_range(F.col("created_at"), clause)
    if kind == "availability":
        return reduce(lambda a, b: a | b, [F.col(v) for v in clause["values"]], F.lit(False))
    return one_of(F.col(kind), clause["values"])


def event_predicate(clause: dict) -> Column:
    """One clause over (seq, time, type, surface, text)."""
    kind = clause["kind"]
    if kind in ("seq", "time"):
        return in_range(F.col(kind), clause)
    if kind == "text":
        return F.coalesce(F.col("text").rlike(text_pattern(clause["text"])), F.lit(False))
    return one_of(F.col(kind), clause["values"])


def filter_sessions(sessions: DataFrame, clauses) -> DataFrame:
    """Sessions that all clauses accept."""
    return reduce(lambda df, c: df.where(session_predicate(c)), session_clauses(clauses), sessions)


def filter_events(events: DataFrame, clauses) -> DataFrame:
    """Event documents that all clauses accept."""
    return reduce(lambda df, c: df.where(event_predicate(c)), event_clauses(clauses), events)


def visible_sessions(sessions: DataFrame, caller: str, cwd: str | None) -> DataFrame:
    """What a caller may see: sessions of its own workspace, and itself; without a workspace only itself."""
    same = F.coalesce(F.col("cwd") == F.lit(cwd), F.lit(False)) if cwd is not None else F.lit(False)
    return sessions.where(same | (F.col("id") == F.lit(caller)) & F.col("cwd").eqNullSafe(F.lit(cwd)))


def authorised_ids(ids: DataFrame, sessions: DataFrame, cwd: str | None) -> DataFrame:
    """The distinct ids whose session stands in the workspace."""
    return ids.select("id").distinct().join(sessions.where(F.col("cwd") == F.lit(cwd)), "id", "left_semi")


def title_terms(column: Column, include: list[str], exclude: list[str]) -> Column:
    """Holds one of the terms to include, and none to exclude."""
    any_of = lambda terms: reduce(lambda a, b: a | b, [F.contains(column, F.lit(t)) for t in terms], F.lit(False))
    return F.coalesce(any_of(include) & ~any_of(exclude), F.lit(False))


def overlapping(start: Column, end: Column, first, last) -> Column:
    """Spans that touch the inclusive interval."""
    return (start <= F.lit(last)) & (end >= F.lit(first))
