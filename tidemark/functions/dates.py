"""Date expressions: same-day cut-offs, year and month ranges that push down, report weeks."""

from __future__ import annotations

import calendar
from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.params import WEEKS_PER_YEAR


def as_day(df: DataFrame, name: str) -> Column:
    """A date or timestamp column as a date; text is parsed leniently, unreadable text becomes NULL.

    Date and timestamp columns are cast plainly so that range filters on the result still reach the scan.
    """
    column = F.col(name)
    if isinstance(df.schema[name].dataType, StringType):
        return column.try_cast("date")
    return column.cast("date")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def same_day_in_year(year: Column, day: date) -> Column:
    """``day``'s month and day in another year; NULL for 29 February in a common year."""
    built = F.make_date(year, F.lit(day.month), F.lit(day.day))
    if (day.month, day.day) == (2, 29):
        return F.when(is_leap(year), built)
    return built


def up_to_same_day(column: Column, day: date, years: Iterable[int] | None = None) -> Column:
    """TRUE when a date falls on or before ``day``'s month and day of its own year.

    Compares month and day numbers, so no date is built per row. A 29 February cut-off has no counterpart
    in common years and admits nothing there. With ``years`` only dates of these do, as a range of each year:
    unlike the comparison, ranges push down to the scan.
    """
    if years is not None:
        known = [y for y in sorted(set(years)) if (day.month, day.day) != (2, 29) or calendar.isleap(y)]
        return _any(between_days(column, date(y, 1, 1), day.replace(year=y)) for y in known)
    reached = F.month(column) * 100 + F.dayofmonth(column) <= day.month * 100 + day.day
    if (day.month, day.day) == (2, 29):
        return reached & is_leap(F.year(column))
    return reached


def between_days(column: Column, first: date, last: date) -> Column:
    return (column >= F.lit(first)) & (column <= F.lit(last))


def in_years(column: Column, years: Iterable[int]) -> Column:
    """Membership in calendar years, as date ranges: unlike ``year(x) IN (...)`` these push down."""
    runs: list[list[int]] = []
    for year in sorted(set(years)):
        if runs and year == runs[-1][1] + 1:
            runs[-1][1] = year
        else:
            runs.append([year, year])
    return _any(between_days(column, date(lo, 1, 1), date(hi, 12, 31)) for lo, hi in runs)


def in_month(column: Column, years: Iterable[int], month: int) -> Column:
    """Membership in one month of several years, as date ranges."""
    return _any(
        between_days(column, date(y, month, 1), date(y, month, calendar.monthrange(y, month)[1])) for y in years
    )


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def wednesday_before(day: Column) -> Column:
    """The last Wednesday strictly before a date."""
    return F.date_sub(F.next_day(F.date_sub(day, 1), "WED"), 7)


def wednesday_on_or_before(day: Column) -> Column:
    return F.date_sub(F.next_day(day, "WED"), 7)


def report_week(day: Column) -> Column:
    """Weeks completed at a date: ISO week less one."""
    return F.weekofyear(day) - 1


def target_share(week: Column) -> Column:
    return week.cast("double") / F.lit(float(WEEKS_PER_YEAR))


def years_back(day: Column, years: int) -> Column:
    """Same day ``years`` earlier; 29 February falls back to the 28th."""
    return F.add_months(day, -12 * years)


def week_start(day: Column) -> Column:
    return F.date_sub(day, 6)


def custom_week(day: Column, start_year: Column, offsets: Mapping[int, int], default_offset: int = 1) -> Column:
    """Week number counted in sevens from a fixed day of the year.

    ``offsets`` gives, for a period's start year, the day of the year on which week 1 begins. Days before it
    fall in week 0.
    """
    offset = F.lit(default_offset)
    for year, value in offsets.items():
        offset = F.when(start_year == year, F.lit(value)).otherwise(offset)
    return (F.floor((F.dayofyear(day) - offset) / F.lit(7.0)) + 1).cast("int")
