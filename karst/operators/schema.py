"""Schema validation and migration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import source_of

_NUMBERS = {"integer", "int", "long", "double", "float", "number"}


@dataclass(frozen=True)
class Field:
    type: str = "string"
    required: bool = False


def errors(df: DataFrame, fields: Mapping[str, Field], strict: bool = False, doc: str | None = None) -> Column:
    """An array of messages, empty for a valid row: required fields that are missing or null, wrong types, unknown fields.

    Any number satisfies any numeric type. strict works on top-level fields.
    """
    source, out = source_of(df, doc), []
    for name, field in fields.items():
        v = source.value(name)
        there = v.present & ~v.null
        if field.required:
            out.append(F.when(~there, F.lit(f"{name}: required")))
        kind = field.type.lower()
        ok = v.num if kind in _NUMBERS else v.flag if kind in ("boolean", "bool") else v.string if kind not in ("map", "object", "list", "array") else None
        if ok is not None:
            out.append(F.when(there & ok.isNull(), F.lit(f"{name}: not of type {field.type}")))
    if strict:
        if doc is None:
            out += [F.lit(f"{c}: unknown") for c in df.columns if c not in fields]
        else:
            keys = F.json_object_keys(F.to_json(doc))
            extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(k, F.lit(": unknown")))
            return F.concat(F.array_compact(F.array(*out, F.lit(None).cast("string"))), F.coalesce(extra, F.array().cast("array<string>")))
    return F.array_compact(F.array(*out, F.lit(None).cast("string")))


@dataclass(frozen=True)
class Migration:
    """A step to a version: add (only if absent), remove, rename, transform, or any function."""

    version: int
    kind: str
    field: str = ""
    value: object = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind == "add":
            return df if self.field in df.columns else df.withColumn(self.field, self.value if isinstance(self.value, Column) else F.lit(self.value))
        if self.kind == "remove":
            return df.drop(self.field)
        if self.kind == "rename":
            return df.withColumnRenamed(self.field, self.value)
        if self.kind == "transform":
            return df.withColumn(self.field, self.value(F.col(self.field)))
        if self.kind == "custom":
            return self.value(df)
        raise ValueError(f"unknown migration {self.kind}")


def migrate(df: DataFrame, steps: Sequence[Migration], current: int = 0) -> tuple[DataFrame, int]:
    """df after the steps above current, by version, and the version reached."""
    for s in sorted(steps, key=lambda s: s.version):
        if s.version > current:
            df, current = s.apply(df), s.version
    return df, current


def map_entity(
    df: DataFrame,
    columns: Mapping[str, str | Callable[[DataFrame], Column]],
    embedded: Mapping[str, Mapping[str, str]] | None = None,
    discriminator: tuple[str, str] | None = None,
) -> DataFrame:
    """Columns under an entity's names: a path of df, or an expression.

    embedded: structs of paths by name; discriminator: a column with the entity's type.
    """
    source = source_of(df)
    out = [(c(df) if callable(c) else source.value(c).key).alias(n) for n, c in columns.items()]
    for name, fields in (embedded or {}).items():
        out.append(F.struct(*[source.value(p).key.alias(n) for n, p in fields.items()]).alias(name))
    if discriminator is not None:
        out.append(F.lit(discriminator[1]).alias(discriminator[0]))
    return df.select(*out)


def unmap_entity(df: DataFrame, columns: Mapping[str, str], embedded: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """The stored columns of entities that map_entity made; expressions aren't taken back."""
    out = [F.col(n).alias(c) for n, c in columns.items() if not callable(c)]
    for name, fields in (embedded or {}).items():
        out += [F.col(name)[n].alias(p) for n, p in fields.items()]
    return df.select(*out)
