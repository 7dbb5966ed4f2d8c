"""Sides of an alignment: identity, basis and observations of one event, and back to an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that identify an event of each type, and those that state its basis.
IDENTITIES = {
    "pledge": ("pledgor", "pledgee", "direction", "start_date", "end_date", "announcement_date"),
    "equity_change": ("holder", "direction", "method", "change_date"),
    "award_contract": ("bidder", "tenderer", "project_name", "bid_date", "contract_signed", "formal_award_notice_received"),
}
BASIS = ("currency", "tax_included", "consortium_members", "consortium_shares", "price_adjustment_status")


def scope(name: Column) -> Column:
    """What a field speaks of, by its name."""
    return (
        F.when(name.endswith("_this_time") | F.contains(name, F.lit("_this_time_")), "single")
        .when(name.endswith("_cumulative") | F.contains(name, F.lit("_cumulative_")), "cumulative")
        .when(name.endswith("_before"), "before")
        .when(name.endswith("_after"), "after")
        .otherwise("unknown")
    )


def sides(events: DataFrame) -> DataFrame:
    """``events`` (event_type, fields: map of name to value) with ``identity``, ``basis`` and ``observations``.

    Identity and basis hold null for what the event does not state; an event of an unknown type has no identity.
    """
    kind = F.col("event_type")
    pick = lambda names: F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.try_element_at("fields", F.lit(n)).alias("v")) for n in names]))
    identity = F.lit(None)
    for name, fields in IDENTITIES.items():
        identity = F.when(kind == name, pick(fields)).otherwise(identity)
    observed = F.transform_values("fields", lambda k, v: F.struct(v.alias("original"), scope(k).alias("scope")))
    return events.withColumns({"identity": identity, "basis": pick(BASIS), "observations": observed})


def as_envelope(side: DataFrame) -> DataFrame:
    """One event with its original fields again; the inverse of ``sides``."""
    return side.withColumn("fields", F.transform_values("observations", lambda k, v: v["original"])).drop("identity", "basis", "observations")
