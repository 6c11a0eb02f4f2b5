"""Weekly series: real, modelled, as registered; long form; week-to-month spans; label positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import melt, sum_metrics
from tidemark.functions.dates import custom_week, in_years, same_day_in_year
from tidemark.functions.text import SHORT_MONTHS, month_label
from tidemark.params import METRICS, SERIES_LABELS, WEEKS_PER_YEAR, ReportParams


def _by_week(rows: DataFrame) -> DataFrame:
    # Calendar year with ISO week: 30 December 2024 is week 1 of 2024.
    return rows.groupBy(F.year("fecha").alias("anio"), F.weekofyear("fecha").alias("semana")).agg(
        *sum_metrics(METRICS)
    )


def weekly_real(rows: DataFrame, params: ReportParams) -> DataFrame:
    return _by_week(rows.where(in_years(F.col("fecha"), params.recent_years)))


def weekly_registered(rows: DataFrame, params: ReportParams) -> DataFrame:
    """Weekly totals of what was registered by the cut-off's day of the event year."""
    kept = rows.where(in_years(F.col("fecha"), params.recent_years))
    return _by_week(kept.where(F.col("fecha_insert") <= same_day_in_year(F.year("fecha"), params.cutoff)))


def weekly_long(weekly: DataFrame, params: ReportParams) -> DataFrame:
    """One row per series, year and week up to the report week, with the weekly target."""
    cells = {
        SERIES_LABELS[m]: {"total": F.col(m), "meta_semanal": F.lit(params.weekly_target(m))} for m in METRICS
    }
    kept = weekly.where(F.col("semana") <= params.week_number)
    return melt(kept, ["anio", "semana"], cells, "procedimiento").withColumn("total", F.col("total").cast("double"))


def weekly_series(real: DataFrame, modelled: DataFrame, params: ReportParams) -> DataFrame:
    """Past years as they happened, the current year as modelled."""
    doubles = [F.col(m).cast("double").alias(m) for m in METRICS]
    past = real.where(F.col("anio") != params.current_year).select("anio", "semana", *doubles)
    return weekly_long(past.unionByName(modelled), params)


def weekly_series_registered(registered: DataFrame, params: ReportParams) -> DataFrame:
    return weekly_long(registered, params)


def custom_weeks(rows: DataFrame, params: ReportParams) -> DataFrame:
    """Totals per year and week counted in sevens from the year's own first day of week 1."""
    year = F.year("fecha")
    kept = rows.where(in_years(F.col("fecha"), params.recent_years))
    week = custom_week(F.col("fecha"), year, params.week_offsets)
    return kept.groupBy(year.alias("anio"), week.alias("semana")).agg(*sum_metrics(METRICS))


def week_month_spans(years: DataFrame) -> DataFrame:
    """First, last and middle week of each month of each year, weeks counted in sevens from 1 January."""
    weeks = years.select("anio", F.explode(F.sequence(F.lit(1), F.lit(WEEKS_PER_YEAR))).alias("week"))
    starts = F.date_add(F.make_date(F.col("anio"), F.lit(1), F.lit(1)), (F.col("week") - 1) * 7)
    return (
        weeks.groupBy("anio", F.month(starts).alias("mes_num"))
        .agg(F.min("week").alias("week_ini"), F.max("week").alias("week_fin"))
        .select(
            "anio",
            "mes_num",
            month_label(F.col("mes_num"), SHORT_MONTHS).alias("mes_lab"),
            "week_ini",
            "week_fin",
            ((F.col("week_ini") + F.col("week_fin")) / F.lit(2.0)).alias("week_mid"),
        )
    )


def last_point_per_year(series: DataFrame) -> DataFrame:
    """Last week with a value, per series and year."""
    return (
        series.where(F.col("total").isNotNull())
        .groupBy("procedimiento", "anio")
        .agg(F.max("semana").alias("semana"), F.max_by("total", "semana").alias("total"))
    )


def label_spacing(series: DataFrame, params: ReportParams) -> DataFrame:
    """Heights of the last points, pushed up so that neighbours keep a minimum gap.

    The gap is a share of the series' range. Pushing up one by one, each height becomes the larger of itself
    and its lower neighbour plus the gap; taking the i-th gap off every height turns that into a running
    maximum. Each window partition holds one row per year.
    """
    points = (
        series.where(F.col("total").isNotNull())
        .groupBy("procedimiento", "anio")
        .agg(
            F.max("semana").alias("semana"),
            F.max_by("total", "semana").alias("total"),
            F.min("total").alias("_low"),
            F.max("total").alias("_high"),
        )
    )
    whole = Window.partitionBy("procedimiento")
    span = F.max("_high").over(whole) - F.min("_low").over(whole)
    gap = F.lit(params.label_gap) * F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0))
    upwards = whole.orderBy("total", "anio")
    running = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = points.withColumn("_gap", gap).withColumn("_i", F.row_number().over(upwards))
    lift = F.col("_i") * F.col("_gap")
    return placed.select(
        "procedimiento",
        "anio",
        "semana",
        "total",
        (F.col("semana") + 0.8).alias("x_lab"),
        (F.max(F.col("total") - lift).over(running) + lift).alias("y_lab"),
    )
