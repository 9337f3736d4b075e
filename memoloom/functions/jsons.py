"""Small helpers over VARIANT: mixed-type JSON without failing rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memoloom.functions.columns import col

VARIANT_MAP = "map<string,variant>"


def parse(c: Column | str) -> Column:
    """VARIANT, or null when the text is not JSON."""
    return F.try_parse_json(col(c))


def field(v: Column, name: str, as_type: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", as_type)


def kind(v: Column) -> Column:
    """Leading word of the value's type, e.g. OBJECT, ARRAY, STRING, BIGINT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def objects(v: Column) -> Column:
    """The object elements of a JSON array; null for anything else than an array."""
    return F.filter(F.try_variant_get(v, "$", "array<variant>"), is_object)


def as_variant(c: Column) -> Column:
    return c.cast("variant")


def string_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*[part for k, v in entries.items() for part in (F.lit(k), as_variant(v))])


def metadata_map(value: Column) -> Column:
    """A metadata value as map: objects as they are, null, false, 0, "" and [] as empty, others under `metadata_raw`."""
    empty = F.create_map().cast(VARIANT_MAP)
    text = value.cast("string")
    falsy = value.isNull() | F.is_variant_null(value) | text.isin("", "false", "0", "0.0", "[]", "{}")
    raw = F.create_map(F.lit("metadata_raw"), value)
    as_map = F.try_variant_get(value, "$", VARIANT_MAP)
    return F.when(falsy, empty).otherwise(F.coalesce(as_map, raw))


def with_defaults(given: Column, defaults: Column) -> Column:
    """`given` plus the entries of `defaults` whose keys it lacks."""
    missing = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(missing, given)


def with_overrides(given: Column, overrides: Column) -> Column:
    """`given` with the entries of `overrides` put over it."""
    return with_defaults(overrides, given)
