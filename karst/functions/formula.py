"""Computed fields: ``"price * quantity"``, ``"UPPER(name)"``, or a field's name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _operand(text: str, source) -> Column:
    text = text.strip()
    try:
        return F.lit(float(text))
    except ValueError:
        return source.value(text).num


def formula(text: str, source) -> Column:
    """One binary operation, a case function, or an alias. x / 0 is 0; non-numbers give null."""
    text = text.strip()
    m = re.fullmatch(r"(?i)(UPPER|LOWER)\((.+)\)", text)
    if m:
        c = source.value(m[2].strip()).text
        return F.upper(c) if m[1].upper() == "UPPER" else F.lower(c)
    for op in "*+-/":
        left, found, right = text.partition(op)
        if found and left.strip() and right.strip():
            a, b = _operand(left, source), _operand(right, source)
            if op == "/":
                return F.when(b == 0, F.when(a.isNotNull(), 0.0)).otherwise(F.try_divide(a, b))
            return {"*": a * b, "+": a + b, "-": a - b}[op]
    return source.value(text).key


def instant(c: Column) -> Column:
    """A number as a time: seconds below 1e11, milliseconds from there on."""
    n = c.cast("double")
    return F.timestamp_millis(F.when(F.abs(n) < 1e11, n * 1000).otherwise(n).cast("bigint"))


def ttl_seconds(expires_at: Column, now_ms: Column) -> Column:
    """Whole seconds until the epoch-millisecond time: -1 for none, 0 once it has passed."""
    left = F.floor((expires_at - now_ms) / 1000).cast("bigint")
    return F.when(expires_at.isNull(), F.lit(-1).cast("bigint")).otherwise(F.greatest(left, F.lit(0).cast("bigint")))


def live(expires_at: Column, now_ms: Column) -> Column:
    return expires_at.isNull() | (expires_at >= now_ms)


def convert(c: Column, kind: str) -> Column:
    """A stored value as integer, long, double, string, boolean, instant, date or uuid; null if it can't be one.

    Numbers as instants follow ``instant``, text is read as an ISO date or time.
    """
    if kind == "instant":
        return F.coalesce(instant(c.try_cast("double")), c.cast("string").try_cast("timestamp"))
    if kind == "uuid":
        text = F.lower(c.cast("string"))
        return F.when(text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), text)
    types = {"integer": "int", "long": "bigint", "double": "double", "string": "string", "boolean": "boolean", "date": "date"}
    return c.try_cast(types[kind])
