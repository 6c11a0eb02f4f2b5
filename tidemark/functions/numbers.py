"""Ratios, growth rates and number labels. Halves round to even; a zero denominator gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth_on_current(current: Column, reference: Column) -> Column:
    """Growth in percent, measured against the current value."""
    current, reference = current.cast("double"), reference.cast("double")
    return F.bround(F.try_divide(current - reference, current) * 100, 0)


def growth_on_reference(current: Column, reference: Column) -> Column:
    """Growth in percent, measured against the reference value."""
    current, reference = current.cast("double"), reference.cast("double")
    return F.bround((F.try_divide(current, reference) - 1) * 100, 0)


def clamp01(value: Column) -> Column:
    """Limit to [0, 1]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(value, F.lit(1.0))))


def floor_at_zero(value: Column) -> Column:
    return F.when(value < 0, F.lit(0).cast("double")).otherwise(value)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def thousands(value: Column) -> Column:
    """Integer part with thousands separators."""
    return F.format_number(value.cast("bigint"), 0)


def _tenths(value: Column, unit: float) -> Column:
    """``value / unit`` to one decimal, rounded on tenths of the unit, which are exact for whole numbers."""
    return F.format_string("%.1f", F.bround(value.cast("double") / F.lit(unit / 10.0), 0) / F.lit(10.0))


def short_scale(value: Column) -> Column:
    """One decimal with K, M, B or T: 1234 becomes 1.2K."""
    size = F.abs(value)
    return (
        F.when(size >= 1e12, F.concat(_tenths(value, 1e12), F.lit("T")))
        .when(size >= 1e9, F.concat(_tenths(value, 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(_tenths(value, 1e6), F.lit("M")))
        .when(size >= 1e3, F.concat(_tenths(value, 1e3), F.lit("K")))
        .when(value.isNotNull(), F.format_string("%.1f", F.bround(value.cast("double"), 1)))
    )


def compact_thousands(value: Column) -> Column:
    return F.concat(_tenths(value, 1e3), F.lit(" mil"))


def percent_label(share: Column) -> Column:
    """A share as a whole percent."""
    return F.concat(F.bround(share * 100, 0).cast("bigint").cast("string"), F.lit("%"))


# A number in running text: an optional sign, digits, and one separator, point or comma.
_NUMBER = r"-?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)"


def rounded_percent_text(text: Column) -> Column:
    """Percent text to a whole percent; text in which digits don't make one number is passed on, NULL becomes empty."""
    alone = F.regexp_extract(text, rf"^[^0-9.,\-]*({_NUMBER})[^0-9.,\-]*$", 1)
    number = F.translate(alone, ",", ".").try_cast("double")
    rounded = F.concat(F.bround(number, 0).cast("bigint").cast("string"), F.lit("%"))
    return F.when(text.isNull(), F.lit("")).otherwise(F.coalesce(rounded, text))


def plain_number(value: Column) -> Column:
    """A number as text with at most one decimal, dropped when zero."""
    rounded = F.bround(value, 1)
    whole = rounded.cast("bigint")
    return F.when(rounded == whole, whole.cast("string")).otherwise(F.format_string("%.1f", rounded))
