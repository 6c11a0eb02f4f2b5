"""Yearly totals: to the same day of each year, as registered, over a window, over several windows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import sum_metrics, sum_or_zero
from tidemark.functions.dates import between_days, in_years, same_day_in_year, up_to_same_day
from tidemark.functions.numbers import ratio
from tidemark.params import METRICS, PERSON_METRICS, ReportParams

# Person-count types and the short names their columns carry.
PERSON_TYPES = {
    "consulta total": "consulta_total",
    "general": "general",
    "especialidad": "especialidad",
    "qx": "qx",
    "egresos": "egresos",
}


def registered_in_time(event: Column, registered: Column, day: date) -> Column:
    """Registered in the year it happened, and by that year's counterpart of ``day``."""
    return (F.year(registered) == F.year(event)) & up_to_same_day(registered, day)


def same_day_cutoff(rows: DataFrame, params: ReportParams) -> DataFrame:
    """Each year's cut-off date, the last event date kept by it and the totals up to it."""
    year = F.year("fecha")
    return (
        rows.where(up_to_same_day(F.col("fecha"), params.cutoff))
        .groupBy(year.alias("anio"))
        .agg(F.max("fecha").alias("ultima_fecha"), *sum_metrics(METRICS))
        .select(
            "anio",
            same_day_in_year(F.col("anio"), params.cutoff).alias("fecha_corte_anio"),
            "ultima_fecha",
            *METRICS,
        )
    )


def ytd_by_year(rows: DataFrame, params: ReportParams, years: Iterable[int] | None = None) -> DataFrame:
    """As-occurred totals of every year, or of the years named, up to the cut-off's day."""
    return (
        rows.where(up_to_same_day(F.col("fecha"), params.cutoff, years))
        .groupBy(F.year("fecha").alias("anio"))
        .agg(*sum_metrics(METRICS))
    )


def as_registered(rows: DataFrame, params: ReportParams) -> DataFrame:
    """As-registered totals of the spine years; unregistered rows count on their event date."""
    registered = F.coalesce(F.col("fecha_insert"), F.col("fecha"))
    return (
        rows.where(in_years(F.col("fecha"), params.years))
        .where(registered_in_time(F.col("fecha"), registered, params.cutoff))
        .groupBy(F.year("fecha").alias("anio"))
        .agg(*sum_metrics(METRICS))
    )


def year_totals(rows: DataFrame, years: Iterable[int], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Full-year totals of the chosen measures and years, all at once."""
    return (
        rows.where(in_years(F.col("fecha"), years))
        .groupBy(F.year("fecha").alias("anio"))
        .agg(*sum_metrics(metrics))
    )


def file_year_totals(rows: DataFrame, years: Iterable[int], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Totals of the chosen file years (``periodo``): all that a year's files hold, undated rows included."""
    return (
        rows.where(F.col("periodo").isin(*years))
        .groupBy(F.col("periodo").cast("int").alias("anio"))
        .agg(*sum_metrics(metrics))
    )


def total_of_year(table: DataFrame, metric: str, year: int) -> DataFrame:
    """One measure of one year from a yearly table; 0 when the year is missing."""
    return table.where(F.col("anio") == year).agg(sum_or_zero(F.col(metric)).alias(metric))


def ytd_share_of_year(rows: DataFrame, params: ReportParams) -> DataFrame:
    """Full-year total, total to the cut-off's day, and their ratio, in one pass over the recent years."""
    rows = rows.where(in_years(F.col("fecha"), params.recent_years))
    # A year without the cut-off's day (29 February) has no share and is left out.
    rows = rows.where(same_day_in_year(F.year("fecha"), params.cutoff).isNotNull())
    rows = rows.withColumn("_reached", up_to_same_day(F.col("fecha"), params.cutoff))
    totals = rows.groupBy(F.year("fecha").alias("anio")).agg(
        *sum_metrics(METRICS, prefix="total_"),
        *sum_metrics(METRICS, condition="_reached", prefix="avance_"),
    )
    shares = [ratio(F.col(f"avance_{m}"), F.col(f"total_{m}")).alias(f"pct_avance_{m}") for m in METRICS]
    return totals.select("*", *shares)


def persons_pivot(persons: DataFrame, params: ReportParams) -> DataFrame:
    """Procedures and persons by type side by side, for one scope."""
    cells = [
        F.sum(F.when(F.col("tipo_procedimiento") == kind, F.col(measure)).otherwise(0))
        .cast("bigint")
        .alias(f"{measure}_{short}")
        for measure in ("procedimientos", "personas")
        for kind, short in PERSON_TYPES.items()
    ]
    kept = persons.where(F.col("anio_insert").isNotNull() & (F.col("id") == params.person_scope))
    return kept.groupBy("anio_insert", "id").agg(*cells)


def persons_by_year(pivoted: DataFrame) -> DataFrame:
    return pivoted.groupBy(F.col("anio_insert").alias("anio")).agg(*sum_metrics(PERSON_METRICS))


@dataclass(frozen=True)
class DayWindow:
    """A day-of-year window: first and last day are carried over to every year."""

    name: str
    first: date
    last: date


def _shift(day: date, year: int) -> date | None:
    try:
        return day.replace(year=year)
    except ValueError:
        return None


def _inside(column: Column, window: DayWindow, years: Iterable[int]) -> Column:
    condition = F.lit(False)
    for year in years:
        first, last = _shift(window.first, year), _shift(window.last, year)
        if first and last:
            condition = condition | between_days(column, first, last)
    return condition


def window_summaries(
    rows: DataFrame,
    windows: Sequence[DayWindow],
    years: Sequence[int],
    force_equal_years: Sequence[int] = (),
) -> DataFrame:
    """Total, as-registered total and their difference per measure, window and year, from one scan.

    A row belongs to every window its date falls in. Rows not registered count as registered. For
    ``force_equal_years`` the as-registered total is taken to be the total.
    """
    event, registered = F.col("fecha"), F.col("fecha_insert")
    reached, flags, sums, cells = F.lit(False), [], [], []
    for k, window in enumerate(windows):
        inside = _inside(event, window, years)
        in_time = registered.isNull() | (registered <= same_day_in_year(F.year(event), window.last))
        reached = reached | inside
        flags += [inside.alias(f"_in{k}"), (inside & in_time).alias(f"_timely{k}")]
        sums += [F.count_if(F.col(f"_in{k}")).alias(f"_n{k}")]
        sums += sum_metrics(METRICS, condition=f"_in{k}", prefix=f"_all{k}_")
        sums += sum_metrics(METRICS, condition=f"_timely{k}", prefix=f"_reg{k}_")
        cells += [
            F.struct(
                F.lit(window.name).alias("periodo"),
                F.lit(metric).alias("procedimiento"),
                F.col(f"_n{k}").alias("_n"),
                F.col(f"_all{k}_{metric}").alias("valor"),
                F.col(f"_reg{k}_{metric}").alias("_reg"),
            )
            for metric in METRICS
        ]
    # The windows' date ranges reach the scan; each window is a conditional sum, so no row is multiplied.
    marked = rows.where(reached).select(F.year(event).alias("anio"), *METRICS, *flags)
    wide = marked.groupBy("anio").agg(*sums).select("anio", F.inline(F.array(*cells)))
    forced = F.col("anio").isin(*force_equal_years) if force_equal_years else F.lit(False)
    in_time = F.when(forced, F.col("valor")).otherwise(F.col("_reg"))
    return wide.where(F.col("_n") > 0).select(
        "periodo",
        "anio",
        "procedimiento",
        "valor",
        in_time.alias("valor_fecha_insert"),
        (F.col("valor") - in_time).alias("diferencia"),
    )


def period_summary(
    rows: DataFrame, first: date, last: date, years: Sequence[int], force_equal_years: Sequence[int] = ()
) -> DataFrame:
    """``window_summaries`` for a single window."""
    window = DayWindow("periodo", first, last)
    return window_summaries(rows, [window], years, force_equal_years).drop("periodo")


def sum_periods(summaries: DataFrame, periods: int) -> DataFrame:
    """Add up the period tables stacked in ``summaries``; a year missing from any of them gives NULL."""
    complete = F.count(F.col("valor")) == periods
    added = summaries.groupBy("procedimiento", "anio").agg(
        F.when(complete, F.sum("valor")).cast("bigint").alias("valor"),
        F.when(complete, F.sum("valor_fecha_insert")).cast("bigint").alias("valor_fecha_insert"),
    )
    return added.withColumn("diferencia", F.col("valor") - F.col("valor_fecha_insert"))
