"""Rounding and division helpers. Money stays DECIMAL until the last step, so sums do not depend on the order of rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T


def rounded(x: Column, digits: int = 2) -> Column:
    """Half-up rounding through DECIMAL, so that 0.285 gives 0.29 whatever the binary value below it."""
    return F.round(x.cast("decimal(38,6)"), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE; NULL for a zero or missing denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def count_true(condition: Column) -> Column:
    """Rows for which the condition holds; like SQL's SUM over a boolean it is NULL when every condition is NULL."""
    return F.sum(condition.cast("int"))


def unscaled(x: Column, scale: int) -> Column:
    """A DECIMAL of the given scale (or a whole number, scale 0) counted in its smallest unit, as BIGINT."""
    return (x * F.lit(10**scale)).cast("bigint") if scale else x.cast("bigint")


def rank_key(df: DataFrame, name: str) -> Column:
    """A column in its smallest unit, to be ranked by: BIGINT, or DECIMAL(38,0) where sums may outgrow that."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType) and kind.precision > 18:
        return (F.col(name) * F.lit(10**kind.scale)).cast("decimal(38,0)")
    return unscaled(F.col(name), scale_of(df, name))


def from_cents(cents: Column) -> Column:
    """A BIGINT number of cents as DECIMAL(18,2)."""
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def scale_of(df: DataFrame, name: str) -> int:
    kind = df.schema[name].dataType
    return kind.scale if isinstance(kind, T.DecimalType) else 0
