"""Column helpers for ratios, calendar arithmetic and conditional measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Named = str | Column


def as_col(value: Named) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(num: Named, den: Named, scale: float = 1.0) -> Column:
    """``scale * num / den`` as double; NULL for a zero or missing denominator."""
    top = as_col(num).cast("double")
    if scale != 1.0:
        top = F.lit(scale) * top
    return F.try_divide(top, as_col(den).cast("double"))


def percent(num: Named, den: Named) -> Column:
    return ratio(num, den, 100.0)


def cents_per(cents: Named, n: Named) -> Column:
    """Average money in whole cents, halves upwards; NULL for a zero denominator."""
    return F.floor(ratio(cents, n) + F.lit(0.5)).cast("long")


def rows_where(cond: Named) -> Column:
    """Aggregate: number of rows where ``cond`` is true (NULL counts as false)."""
    return F.count_if(as_col(cond))


def sum_where(value: Named, cond: Named) -> Column:
    return F.sum(F.when(as_col(cond), as_col(value)))


def money_sum(df: DataFrame, name: str) -> Column:
    """Aggregate: ``sum`` of an amount, of the same type. A sum of more than 18 digits is a byte array that every row unpacks and
    packs again; amounts of at most 15 digits, two of them cents, are added as whole cents instead, in two 64-bit sums
    (multiples of 2^20 and the rest) that no table overflows."""
    kind = df.schema[name].dataType
    if not (isinstance(kind, T.DecimalType) and kind.scale == 2 and 8 < kind.precision <= 15):
        return F.sum(name)
    cents = F.rint(F.col(name).cast("double") * 100).cast("bigint")  # below 2^53, so the nearest whole number is the one meant
    whole = F.sum(F.shiftright(cents, 20)).cast("decimal(38,0)") * F.lit(1 << 20) + F.sum(cents.bitwiseAND(F.lit((1 << 20) - 1)))
    return (whole * F.lit("0.01").cast("decimal(3,2)")).cast(T.DecimalType(kind.precision + 10, 2))


def avg_where(value: Named, cond: Named) -> Column:
    return F.avg(F.when(as_col(cond), as_col(value)))


def count_where(value: Named, cond: Named) -> Column:
    """Aggregate: non-NULL values among the rows where ``cond`` is true."""
    return F.count(F.when(as_col(cond), as_col(value)))


def day_gap(start: Named, end: Named) -> Column:
    """Calendar days from ``start`` to ``end``: midnights crossed, not full 24-hour spans."""
    return F.datediff(as_col(end), as_col(start))


def month_start(ts: Named) -> Column:
    return F.trunc(as_col(ts), "MM")


def month_label(day: Named) -> Column:
    return F.date_format(as_col(day), "yyyy-MM")


def month_number(day: Named) -> Column:
    """Months since year 0, so differences are whole months."""
    return F.year(as_col(day)) * 12 + F.month(as_col(day))


def weekday_from_sunday(day: Named) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(as_col(day)) - 1


def weekday_from_monday(day: Named) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(as_col(day))


def in_half_open(ts: Named, start: str, end: str) -> Column:
    """``start <= ts < end`` for timestamp literals in ISO form."""
    moment = as_col(ts)
    return (moment >= F.lit(start).cast("timestamp_ntz")) & (moment < F.lit(end).cast("timestamp_ntz"))
