"""Location predicates over struct<unit, start, end> columns (closed integer spans; null bound: whole unit)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans_overlap(a: Column, b: Column) -> Column:
    return F.coalesce((a["start"] <= b["end"]) & (b["start"] <= a["end"]), F.lit(True)) | (
        a["start"].isNull() | a["end"].isNull() | b["start"].isNull() | b["end"].isNull()
    )


def compatibility(a: Column, b: Column) -> Column:
    """same, disjoint or (where either is not located) unknown."""
    return (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(~a["unit"].eqNullSafe(b["unit"]), "disjoint")
        .when(spans_overlap(a, b), "same")
        .otherwise("disjoint")
    )


def in_gray_zone(location: Column, zones: Column) -> Column:
    """Positional policy: the location overlaps a zone of its unit (zones: array<struct<location, note>>)."""
    hit = lambda z: (z["location"]["unit"] == location["unit"]) & spans_overlap(location, z["location"])
    return F.coalesce(location.isNotNull() & F.exists(zones, hit), F.lit(False))


def note_applies(location: Column, zone: Column) -> Column:
    """Whether a zone's note counts for a finding there: the finding has no place, or lies in the zone's region (null:
    unknown); a finding with a start only is a point there."""
    at, end = zone["location"], F.coalesce(location["end"], location["start"])
    region = at["start"].isNull() | at["end"].isNull() | ((at["unit"] == location["unit"]) & (location["start"] <= at["end"]) & (at["start"] <= end))
    return (F.coalesce(zone["note"], F.lit("")) != "") & (location.isNull() | location["start"].isNull() | region)


def gray_by_note(location: Column, zones: Column, similarity: Column, tau: float = 0.18) -> Column:
    """Semantic policy: a zone's note matches the claim (similarity: array aligned with zones, read where the note applies)
    and, where the finding is located, its region does."""
    z = F.arrays_zip(zones.alias("zone"), similarity.alias("sim"))
    return F.coalesce(F.exists(z, lambda x: note_applies(location, x["zone"]) & (x["sim"] >= tau)), F.lit(False))
