"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reasonmill.schema import as_column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def indexed(values: Column) -> Column:
    """``array<struct<pos,item>>`` with 0-based positions."""
    return F.transform(values, lambda v, i: F.struct(i.alias("pos"), v.alias("item")))


def harmonic_mean(precision: Column, recall: Column) -> Column:
    """NULL when a side is undefined, 0 when both are 0."""
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(2 * precision * recall, total))


def share(part: Column, whole: Column) -> Column:
    """Quotient as double, NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fixed4(c: Column) -> Column:
    """Four decimals for reports; undefined prints as N/A."""
    return F.when(c.isNotNull(), F.format_string("%.4f", c)).otherwise("N/A")


def defined(c: Column | str) -> Column:
    """NaN on input means undefined: NULL here."""
    return F.nullif(as_column(c), F.lit(float("nan")))
