"""Tag predicates and labels, as column expressions over a tag map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import POI_KINDS, RIDE_UP, TRANSIT_KINDS


def tag(tags: Column, key: str) -> Column:
    return tags.getItem(key)


def is_in(tags: Column, key: str, values: tuple[str, ...]) -> Column:
    """Null-safe: an absent key is False."""
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def poi_kind(tags: Column) -> Column:
    """The first kind that fits, or null."""
    out = []
    for name, kind in POI_KINDS.items():
        fits = is_in(tags, kind.key, kind.values)
        for key, values in kind.exclude:
            fits = fits & ~is_in(tags, key, values)
        for key in kind.require:
            fits = fits & F.coalesce(F.map_contains_key(tags, key), F.lit(False))
        out.append(F.when(fits, F.lit(name)))
    return F.coalesce(*out)


def transit_kind(tags: Column) -> Column:
    return F.coalesce(*(F.when(is_in(tags, key, (value,)), F.lit(name)) for name, (key, value, _, _) in TRANSIT_KINDS.items()))


def is_rail(kind: Column) -> Column:
    return kind.isin(*(name for name, spec in TRANSIT_KINDS.items() if spec[3]))


def lift_kind(tags: Column) -> Column:
    """The aerialway's kind if one can ride up on it."""
    return F.when(is_in(tags, "aerialway", RIDE_UP), tag(tags, "aerialway"))


def way_is_ferrata(tags: Column) -> Column:
    """The scale counts by its presence: a value of 0 is cabled as well."""
    return is_in(tags, "highway", ("via_ferrata",)) | F.coalesce(F.map_contains_key(tags, "via_ferrata_scale"), F.lit(False))


def relation_is_ferrata(tags: Column) -> Column:
    return is_in(tags, "route", ("via_ferrata",)) | F.coalesce(F.map_contains_key(tags, "via_ferrata_scale"), F.lit(False))


def ferrata_scale(tags: Column) -> Column:
    return F.nullif(F.trim(tag(tags, "via_ferrata_scale")), F.lit(""))


def label(value: Column, labels: dict[str, str]) -> Column:
    """A known value's label; any other value with spaces for underscores."""
    known = reduce(lambda x, y: x.when(value == y[0], F.lit(y[1])), list(labels.items())[1:], F.when(value == list(labels)[0], F.lit(list(labels.values())[0])))
    return known.otherwise(F.replace(value, F.lit("_"), F.lit(" ")))


def unrecorded(recorded: Column, requested: Column) -> tuple[Column, Column]:
    """The requested kinds that an area never recorded, and the state: none, unknown, missing or ok."""
    lacking = F.array_except(requested, F.coalesce(recorded, F.array().cast("array<string>")))
    state = F.when(F.size(requested) == 0, "none").when(recorded.isNull(), "unknown").when(F.size(lacking) > 0, "missing").otherwise("ok")
    return lacking, state
