"""Hash operations on map columns; a null hash is an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _map(fields: Column) -> Column:
    return F.coalesce(fields, F.create_map().cast("map<string,string>"))


def _given(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).cast("map<string,string>")


def set_(fields: Column, values: dict[str, str]) -> Column:
    """fields with values on top."""
    new = list(values)
    return F.map_concat(F.map_filter(_map(fields), lambda k, _: ~k.isin(new)), _given(values))


def added(fields: Column, values: dict[str, str]) -> Column:
    """How many of the fields are new."""
    return F.size(F.array_except(F.array(*map(F.lit, values)), F.map_keys(_map(fields))))


def set_if_absent(fields: Column, field: str, value: str) -> Column:
    return F.when(contains(fields, field), fields).otherwise(set_(fields, {field: value}))


def get(fields: Column, field: str) -> Column:
    return F.try_element_at(_map(fields), F.lit(field))


def get_many(fields: Column, names: list[str]) -> Column:
    """The fields that exist."""
    return F.map_filter(_map(fields), lambda k, _: k.isin(names))


def delete(fields: Column, names: list[str]) -> Column:
    return F.map_filter(_map(fields), lambda k, _: ~k.isin(names))


def size(fields: Column) -> Column:
    return F.size(_map(fields))


def contains(fields: Column, field: str) -> Column:
    return F.map_contains_key(_map(fields), F.lit(field))


def keys(fields: Column) -> Column:
    return F.map_keys(_map(fields))


def values(fields: Column) -> Column:
    return F.map_values(_map(fields))


def flat(fields: Column) -> Column:
    """[key, value, key, value, ...]"""
    return F.flatten(F.transform(F.map_entries(_map(fields)), lambda e: F.array(e["key"], e["value"])))


def increment(fields: Column, field: str, by: int | float) -> Column:
    """The number in field, 0 if missing, plus by."""
    kind = "double" if isinstance(by, float) else "bigint"
    total = F.coalesce(get(fields, field).cast(kind), F.lit(0).cast(kind)) + F.lit(by).cast(kind)
    one = F.create_map(F.lit(field), total.cast("string"))
    return F.map_concat(delete(fields, [field]), one)


def value_length(fields: Column, field: str) -> Column:
    return F.coalesce(F.length(get(fields, field)), F.lit(0))
