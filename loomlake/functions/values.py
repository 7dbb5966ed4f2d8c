"""JSON values, counts, ranges of sequence numbers, boxes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = 2**53 - 1


def safe_count(value: Column) -> Column:
    """A non-negative whole number that a double holds exactly, from a string; null for all others."""
    n = F.try_to_number(value, F.lit("9999999999999999")).cast("long")
    return F.when(value.rlike("^(0|[1-9][0-9]{0,15})$") & (n <= SAFE), n)


def encode_ranges(values: Column) -> Column:
    """A strictly increasing array as runs (start, end) of three or more, and single numbers otherwise.

    Any other array comes back number by number. ``end`` is null for a single number.
    """
    pair = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    none = F.lit(None).cast("long")
    singles = F.transform(values, lambda v: pair(v, none))
    runs = F.aggregate(
        values,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda out, v: F.when((F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1)) * 0 - 1)["end"] + 1 == v), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(pair(F.element_at(out, -1)["start"], v)))).otherwise(F.concat(out, F.array(pair(v, v)))),
    )
    short = F.flatten(F.transform(runs, lambda r: F.when(r["end"] - r["start"] >= 2, F.array(r)).otherwise(F.transform(F.sequence(r["start"], r["end"]), lambda v: pair(v, none)))))
    rising = F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)
    return F.when(rising, short).otherwise(singles)


def decode_ranges(ranges: Column, most: Column | int = SAFE) -> Column:
    """The numbers of encoded ranges; null where a bound is wrong, runs do not rise, or there are more than ``most``."""
    most = F.lit(most) if isinstance(most, int) else most
    bad = F.exists(ranges, lambda r: F.coalesce((r["start"] < 0) | (r["start"] > SAFE), F.lit(True)) | F.coalesce((r["end"] < r["start"]) | (r["end"] > SAFE), F.lit(False)))
    count = F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["end"] - r["start"], F.lit(0).cast("long")) + 1)
    values = F.flatten(F.transform(ranges, lambda r: F.sequence(r["start"], F.coalesce(r["end"], r["start"]))))
    has_run = F.exists(ranges, lambda r: r["end"].isNotNull())
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ranges) - 1, F.lit(1))), lambda k: F.coalesce(F.try_element_at(ranges, k + 1)["start"] <= F.coalesce(F.try_element_at(ranges, k)["end"], F.try_element_at(ranges, k)["start"]), F.lit(False)))
    return F.when(~(bad | (count > most) | (has_run & falls)), values)


def box_issue(region: Column) -> Column:
    """What is wrong with a box [left, top, right, bottom]: the names of the rules it breaks; a null box breaks none."""
    at = lambda k: F.try_element_at(region, F.lit(k))
    left, top, right, bottom = (at(k) for k in (1, 2, 3, 4))
    bad = F.exists(F.array(left, top, right, bottom), lambda x: x.isNull() | F.isnan(x))
    rules = F.array_compact(F.array(F.when((left < 0) | (top < 0), F.lit("negative")), F.when(left >= right, F.lit("left_right")), F.when(top >= bottom, F.lit("top_bottom"))))
    return F.when(region.isNull(), F.array().cast("array<string>")).when(bad, F.array(F.lit("not_a_number"))).otherwise(rules)


def outside_page(region: Column, width: Column, height: Column, slack: float = 0.5) -> Column:
    """Whether a box leaves its page by more than the slack; false where box or page is unknown."""
    at = lambda k: F.try_element_at(region, F.lit(k))
    return F.coalesce((at(3) > width + slack) | (at(4) > height + slack) | (at(1) < -slack) | (at(2) < -slack), F.lit(False))


def _kind(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "integer" if float(x).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def same_value(a, b) -> bool:
    """Equal as JSON, whatever the order of keys; 1 equals 1.0, but true does not equal 1."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_value(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_value, a, b))
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def schema_issues(value, schema, root=None, path: str = "$") -> list[str]:
    """``path: keyword`` of every constraint of the schema subset that a value breaks."""
    root = schema if root is None else root
    if schema is True or schema is None:
        return []
    if schema is False:
        return [f"{path}: not_allowed"]
    if "$ref" in schema:
        node = root
        for step in [p for p in schema["$ref"][1:].split("/") if p]:
            node = node.get(step.replace("~1", "/").replace("~0", "~")) if isinstance(node, dict) else None
        return [f"{path}: $ref"] if node is None or schema["$ref"][:1] != "#" else schema_issues(value, node, root, path)
    out: list[str] = []
    for part in schema.get("allOf", ()):
        out += schema_issues(value, part, root, path)
    checks = [
        ("anyOf", lambda s: any(not schema_issues(value, p, root, path) for p in s)),
        ("const", lambda s: same_value(value, s)),
        ("enum", lambda s: any(same_value(value, x) for x in s)),
        ("type", lambda s: any(t == _kind(value) or t == "number" and _kind(value) == "integer" for t in (s if isinstance(s, list) else [s]))),
    ]
    if isinstance(value, list):
        checks += [("minItems", lambda s: len(value) >= s), ("maxItems", lambda s: len(value) <= s)]
    if isinstance(value, str):
        checks += [("minLength", lambda s: len(value) >= s), ("pattern", lambda s: re.search(s, value) is not None)]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        checks.append(("minimum", lambda s: value >= s))
    out += [f"{path}: {name}" for name, holds in checks if name in schema and not holds(schema[name])]
    if isinstance(value, dict):
        own, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            out += schema_issues(v, own.get(k, other), root, f"{path}.{k}")
    if isinstance(value, list):
        for k, v in enumerate(value):
            out += schema_issues(v, schema.get("items", True), root, f"{path}[{k}]")
    return out


def _loads(text):
    def refuse(_):
        raise ValueError

    try:
        return True, json.loads(text, parse_constant=refuse)
    except (ValueError, TypeError, RecursionError):
        return False, None


def validator(schema: dict):
    """A column function: the broken constraints of a JSON text; ``$: json`` where it is no JSON."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            ok, value = _loads(t)
            return schema_issues(value, schema) if ok else ["$: json"]

        return pd.Series([one(t) for t in text], dtype=object)

    return run


@F.pandas_udf(T.BooleanType())
def deep_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two JSON texts hold the same value; null where either is no JSON."""

    def one(x, y):
        (good, v), (fine, w) = _loads(x), _loads(y)
        return same_value(v, w) if good and fine else None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def snapshot(text: pd.Series) -> pd.Series:
    """The value of a JSON text in canonical form (sorted keys); null for what JSON cannot carry."""

    def one(t):
        ok, value = _loads(t)
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if ok else None

    return pd.Series([one(t) for t in text], dtype=object)
