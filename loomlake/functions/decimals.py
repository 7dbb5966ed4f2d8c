"""Exact decimals as strings of up to 120 characters, beyond what DECIMAL(38) can hold.

A decimal has no leading zeros, exponent, separators or trailing zeros, and no negative zero. What is
no decimal is null, and null in gives null out. Parsing and shifting are string expressions; sums go
over limbs of nine digits with Spark's own aggregation; products, comparisons and rounding of single
values run on Python's integers over Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAMMAR = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
LONGEST = 120
#: White space as scripts trim it: Unicode blanks and the byte order mark.
EDGES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
LIMB, LIMBS = 9, 14

#: Powers of ten of the units that texts state, and the canonical unit of each kind.
FACTORS = {"amount": {"元": 0, "万元": 4, "亿元": 8}, "shares": {"股": 0, "万股": 4, "亿股": 8}, "ratio": {"%": 0}}
CANONICAL = {"amount": "元", "shares": "股", "ratio": "%"}
STATUSES = ("present", "not_mentioned", "explicit_zero", "unreadable")
SCOPES = ("single", "cumulative", "unknown")
QUALIFIERS = ("exact", "approx", "at_most")
DENOMINATORS = ("total_share_capital", "holder_shares", "net_assets", "other")


def parse(text: Column) -> Column:
    """The canonical decimal of a string; null if it is none."""
    s = F.regexp_replace(text.cast("string"), EDGES, "")
    cut = F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    return F.when((F.length(s) <= LONGEST) & s.rlike(GRAMMAR), F.when(cut == "-0", "0").otherwise(cut))


def shift(decimal: Column, places: int) -> Column:
    """The decimal times ten to the ``places`` (not negative), by moving its point."""
    body = F.regexp_replace(decimal, "^-", "")
    whole = F.substring_index(body, ".", 1)
    fraction = F.when(F.contains(body, F.lit(".")), F.substring_index(body, ".", -1)).otherwise(F.lit(""))
    point = F.length(whole) + places
    digits = F.rpad(F.concat(whole, fraction), F.greatest(point + 1, F.length(whole) + F.length(fraction)), F.lit("0"))
    integer = F.regexp_replace(F.substring(digits, F.lit(1), point), "^0+(?=[0-9])", "")
    rest = F.regexp_replace(F.substring(digits, point + 1, F.length(digits)), "0+$", "")
    out = F.concat(integer, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    return F.when(decimal.startswith("-") & (out != "0"), F.concat(F.lit("-"), out)).otherwise(out)


def _parts(x: str) -> tuple[int, int]:
    whole, _, fraction = x.partition(".")
    return int(whole + fraction), len(fraction)


def _render(value: int, scale: int) -> str:
    digits = str(abs(value)).rjust(scale + 1, "0")
    out = digits if not scale else (digits[:-scale] + "." + digits[-scale:]).rstrip("0").rstrip(".")
    return "-" + out if value < 0 and out != "0" else out


@F.pandas_udf(T.StringType())
def _multiply(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        (m, i), (n, j) = _parts(x), _parts(y)
        out = _render(m * n, i + j)
        return out if len(out) <= LONGEST else None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def _compare(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        (m, i), (n, j) = _parts(x), _parts(y)
        k = max(i, j)
        m, n = m * 10 ** (k - i), n * 10 ** (k - j)
        return (m > n) - (m < n)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _rounder(places: int):
    @F.pandas_udf(T.StringType())
    def run(a: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            value, scale = _parts(x)
            if scale <= places:
                return x
            unit = 10 ** (scale - places)
            whole, rest = divmod(abs(value), unit)
            whole = (whole + (2 * rest >= unit)) * (-1 if value < 0 else 1)
            return _render(whole * 10**-places, 0) if places < 0 else _render(whole, places)

        return pd.Series([one(x) for x in a], dtype=object)

    return run


def multiply(a: Column, b: Column) -> Column:
    """The exact product; null where an operand is no decimal or the product is too long."""
    return _multiply(parse(a), parse(b))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where an operand is no decimal."""
    return _compare(parse(a), parse(b))


def round_half_up(a: Column, places: int) -> Column:
    """Halves go away from zero; ``places`` from -8 to 30."""
    if not -8 <= places <= 30:
        raise ValueError("places must be from -8 to 30")
    return _rounder(places)(parse(a))


@F.pandas_udf(T.StringType())
def _joined(limbs: pd.Series) -> pd.Series:
    def one(row):
        if row is None:
            return None
        total = 0
        for x in row:
            total = total * 10**LIMB + int(x)
        return _render(total, LIMB * LIMBS)

    return pd.Series([one(x) for x in limbs], dtype=object)


def exact_sum(df: DataFrame, keys: list[str], value: Column, out: str = "total") -> DataFrame:
    """The exact sum of each group; null if an item is no decimal. Sums are partial before the shuffle."""
    d = parse(value)
    body = F.regexp_replace(d, "^-", "")
    whole = F.lpad(F.substring_index(body, ".", 1), LIMB * LIMBS, "0")
    fraction = F.rpad(F.when(F.contains(body, F.lit(".")), F.substring_index(body, ".", -1)).otherwise(F.lit("")), LIMB * LIMBS, "0")
    digits = F.concat(whole, fraction)
    sign = F.when(d.startswith("-"), -1).otherwise(1)
    limbs = [(sign * F.substring(digits, 1 + LIMB * k, LIMB).cast("long")).alias(f"_{k}") for k in range(2 * LIMBS)]
    cut = df.select(*keys, d.isNull().alias("_bad"), *limbs)
    sums = cut.groupBy(*keys).agg(F.max("_bad").alias("_bad"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"_{k}") for k in range(2 * LIMBS)])
    return sums.select(*keys, F.when(~F.col("_bad"), _joined(F.array(*[f"_{k}" for k in range(2 * LIMBS)]))).alias(out))


def measure(kind: Column, status: Column, scope: Column, raw_text: Column, raw_value: Column, unit: Column, qualifier: Column, denominator: Column, definition: Column, unknown_denominator: bool = False) -> Column:
    """(value, unit, error) of a stated measure, in the canonical unit of its kind; value is null on error.

    A missing or unreadable measure has no value and no error; missing is never zero.
    """
    is_in = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    stated = is_in(status, ("present", "explicit_zero"))
    no_denominator = denominator.isNull() & definition.isNull()
    good_denominator = is_in(denominator, DENOMINATORS) & F.coalesce(F.trim(definition) != "", F.lit(False))
    if unknown_denominator:
        good_denominator = good_denominator | no_denominator
    places = F.lit(None).cast("int")
    value = F.lit(None).cast("string")
    for k, units in FACTORS.items():
        for u, p in units.items():
            here = (kind == k) & (unit == u)
            places, value = F.when(here, p).otherwise(places), F.when(here, shift(raw_value, p)).otherwise(value)
    grammatical = F.coalesce(raw_value.rlike(GRAMMAR), F.lit(False))
    error = (
        F.when(~is_in(kind, FACTORS) | ~is_in(status, STATUSES) | ~is_in(scope, SCOPES), "invalid_kind")
        .when((kind == "ratio") & stated & ~good_denominator, "denominator_required")
        .when(~((kind == "ratio") & stated) & ~no_denominator, "denominator_not_allowed")
        .when(~stated & (raw_value.isNotNull() | unit.isNotNull() | qualifier.isNotNull()), "missing_with_number")
        .when(stated & (~F.coalesce(F.trim(raw_text) != "", F.lit(False)) | ~grammatical | places.isNull() | ~is_in(qualifier, QUALIFIERS)), "invalid_number")
        .when(stated & (kind == "shares") & F.contains(value, F.lit(".")), "not_whole_shares")
        .when((status == "explicit_zero") & ((value != "0") | (qualifier != "exact")), "zero_not_stated")
        .when((status == "present") & (value == "0") & (qualifier == "exact"), "zero_not_declared")
    )
    own = F.lit(None).cast("string")
    for k, u in CANONICAL.items():
        own = F.when(kind == k, u).otherwise(own)
    return F.struct(F.when(error.isNull() & stated, value).alias("value"), F.when(error.isNull(), own).alias("unit"), error.alias("error"))


def stated_value(raw: Column, unit: Column, kind: str = "shares") -> Column:
    """A stated number in its canonical unit; null on any failure."""
    d, null = parse(raw), F.lit(None).cast("string")
    status = F.when(d == "0", "explicit_zero").when(d.isNotNull(), "present")
    return measure(F.lit(kind), status, F.lit("unknown"), F.concat(raw, unit), d, unit, F.lit("exact"), null, null, unknown_denominator=True)["value"]
