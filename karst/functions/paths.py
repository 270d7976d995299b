"""Dotted paths into typed columns and variant documents.

A ``Value`` is what a path leads to, as a bundle of columns with the guards that the
predicates need. Typed input resolves at plan-building time, so type guards cost nothing
at run time and comparisons stay pushable to the scan; variant input guards by the
stored type.

Missing and null differ: ``present`` is true for a stored null. A null in a typed column
counts as missing, as columnar data has no separate mark for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def sure(c: Column) -> Column:
    """c with unknown as false, so that negation behaves like two-valued logic."""
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Value:
    present: Column
    #: a stored null
    null: Column
    #: the number as double, or null if it isn't a number
    num: Column
    #: the string, or null if it isn't a string
    string: Column
    #: the boolean, or null if it isn't one
    flag: Column
    #: any scalar as text, or null
    text: Column
    integral: Column
    #: what to sort and group by
    key: Column
    #: whether num, string, flag and text are there; never null, and a plain null test on a
    #: typed column, so that "known and compares" reaches the scan as a pushed filter
    has_num: Column
    has_string: Column
    has_flag: Column
    has_text: Column


def _absent() -> Value:
    none = F.lit(None)
    no = F.lit(False)
    text = none.cast("string")
    return Value(no, no, none.cast("double"), text, none.cast("boolean"), text, no, text, no, no, no, no)


def _typed(c: Column, kind: T.DataType) -> Value:
    none = _absent()
    number = isinstance(kind, (*_INTEGRAL, *_FRACTIONAL))
    scalar = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    return Value(
        present=c.isNotNull(),
        null=F.lit(False),
        num=c.cast("double") if number else none.num,
        string=c if isinstance(kind, T.StringType) else none.string,
        flag=c if isinstance(kind, T.BooleanType) else none.flag,
        text=c.cast("string") if scalar else none.text,
        integral=F.lit(isinstance(kind, _INTEGRAL)),
        key=c,
        has_num=c.isNotNull() if number else none.has_num,
        has_string=c.isNotNull() if isinstance(kind, T.StringType) else none.has_string,
        has_flag=c.isNotNull() if isinstance(kind, T.BooleanType) else none.has_flag,
        has_text=c.isNotNull() if scalar else none.has_text,
    )


class TypedSource:
    """Paths into the columns of a DataFrame."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def value(self, path: str) -> Value:
        head, *rest = path.split(".")
        if head not in self.schema.names:
            return _absent()
        c, kind = F.col(f"`{head}`"), self.schema[head].dataType
        for step in rest:
            if isinstance(kind, T.StructType) and step in kind.names:
                c, kind = c.getField(step), kind[step].dataType
            elif isinstance(kind, T.ArrayType) and step.isdigit():
                c, kind = F.get(c, F.lit(int(step))), kind.elementType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                c, kind = F.try_element_at(c, F.lit(step)), kind.valueType
            elif isinstance(kind, T.VariantType):
                return VariantSource(c).value(".".join(rest[rest.index(step) :]))
            else:
                return _absent()
        if isinstance(kind, T.VariantType):
            return _variant(c)
        return _typed(c, kind)


def _variant(v: Column) -> Value:
    kind = F.schema_of_variant(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    get = lambda t: F.try_variant_get(v, "$", t)
    num, string = F.when(number, get("double")), F.when(kind == "STRING", get("string"))
    flag = F.when(kind == "BOOLEAN", get("boolean"))
    text = F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), get("string"))
    return Value(
        present=v.isNotNull(),
        null=sure(F.is_variant_null(v)),
        num=num,
        string=string,
        flag=flag,
        text=text,
        integral=sure(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")),
        key=get("string"),
        has_num=num.isNotNull(),
        has_string=string.isNotNull(),
        has_flag=flag.isNotNull(),
        has_text=text.isNotNull(),
    )


class VariantSource:
    """Paths into a variant column; a numeric step may be a map key or an array index."""

    def __init__(self, doc: Column):
        self.doc = doc

    def value(self, path: str) -> Value:
        steps = path.split(".")
        forms = ["$"]
        for s in steps:
            quoted = s.replace("'", "")
            forms = [f + x for f in forms for x in ([f"['{quoted}']", f"[{int(s)}]"] if s.isdigit() else [f"['{quoted}']"])]
        return _variant(F.coalesce(*[F.try_variant_get(self.doc, f, "variant") for f in forms]))


def source_of(df: DataFrame, doc: str | None = None) -> TypedSource | VariantSource:
    """Where paths of df lead: into its columns, or into the variant column doc."""
    return TypedSource(df.schema) if doc is None else VariantSource(F.col(doc))
