"""Numeric and payload expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column reference that tolerates hyphens and dots in sensor names."""
    return F.col(f"`{name}`")


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def array_of(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def whole_seconds(timestamp: Column) -> Column:
    """Timestamp text without fractional seconds."""
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")


def name_of(number: Column, names: dict[int, str], otherwise: Column) -> Column:
    """Dictionary lookup as a literal map, with a default."""
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return F.coalesce(F.try_element_at(table, number.cast("int")), otherwise)


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970, whatever the timestamp type."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(ts)
