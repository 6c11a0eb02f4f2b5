"""Late registration: what was registered by the cut-off, and what came or is expected to come after it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import inline_table, melt, sum_where
from tidemark.functions.dates import between_days, in_month, in_years, up_to_same_day
from tidemark.functions.numbers import floor_at_zero, growth_on_current, growth_on_reference
from tidemark.operators.nowcast import nowcast_total
from tidemark.operators.totals import registered_in_time
from tidemark.params import METRICS, ReportParams

# Fixed value: name of the late part in past years.
LATE_LABEL = "Registro extemporáneo"


def projection_label(year: int) -> str:
    return f"Proyección {year}"


def _registered_date() -> Column:
    return F.coalesce(F.col("fecha_insert"), F.col("fecha"))


def _is_past(params: ReportParams) -> Column:
    return F.col("fecha") < F.lit(params.current_year_start)


def _first_year_limit(params: ReportParams) -> Column:
    return F.lit(date(params.first_year, params.month, params.first_year_day))


def _per_year(rows: DataFrame, registered: Column, occurred: Column) -> DataFrame:
    """Both totals of every measure per year from one scan; NULL where no row qualifies."""
    marked = rows.select(F.year("fecha").alias("anio"), registered.alias("_r"), occurred.alias("_o"), *METRICS)
    wide = marked.groupBy("anio").agg(*sum_where(METRICS, "_r", "_reg_"), *sum_where(METRICS, "_o", "_occ_"))
    cells = {m: {"registrado": F.col(f"_reg_{m}"), "ocurrido": F.col(f"_occ_{m}")} for m in METRICS}
    return melt(wide, ["anio"], cells, "procedimiento")


def _projection(nowcast: DataFrame, first: date, last: date, params: ReportParams) -> DataFrame:
    """Modelled total of every measure for a stretch of the current year, one row per measure."""
    total = nowcast_total(nowcast.where(between_days(F.col("fecha"), first, last)))
    cells = {m: {"proyeccion": F.col(m)} for m in METRICS}
    return melt(total.withColumn("anio", F.lit(params.current_year)), ["anio"], cells, "procedimiento")


def _decompose(per_year: DataFrame, projection: DataFrame, params: ReportParams, growth) -> DataFrame:
    spark = per_year.sparkSession
    spine = inline_table(
        spark,
        ("anio", "x", "procedimiento"),
        [(year, place, m) for place, year in enumerate(params.years, start=1) for m in METRICS],
    )
    keys = ["anio", "procedimiento"]
    year = F.col("anio")
    is_current, is_first = year == params.current_year, year == params.first_year
    # Both broadcast sides are bounded: a row per spine year and measure, and a row per measure.
    base = (
        spine.join(F.broadcast(per_year), keys, "left")
        .join(F.broadcast(projection), keys, "left")
        .withColumn("valor_fecha_insert", F.coalesce(F.col("registrado").cast("double"), F.lit(0.0)))
        .withColumn(
            "valor_total",
            F.coalesce(
                F.when(is_current, F.col("proyeccion")).otherwise(F.col("ocurrido").cast("double")),
                F.col("valor_fecha_insert"),
            ),
        )
        .withColumn(
            "superior_graf",
            F.when(is_first, F.lit(0.0)).otherwise(floor_at_zero(F.col("valor_total") - F.col("valor_fecha_insert"))),
        )
        .withColumn("total_graf", F.col("valor_fecha_insert") + F.col("superior_graf"))
        .withColumn(
            "tipo_superior",
            F.when(is_current, projection_label(params.current_year)).when(~is_first, LATE_LABEL),
        )
    )
    # Each partition holds one row per spine year.
    by_year = Window.partitionBy("procedimiento").orderBy("anio")
    previous = F.lag("total_graf").over(by_year)
    return base.select(
        "procedimiento",
        "anio",
        "valor_fecha_insert",
        "valor_total",
        "superior_graf",
        "total_graf",
        "tipo_superior",
        "x",
        F.when(is_current, growth(F.col("total_graf"), previous)).alias("pct_incremento"),
    )


def late_registration_ytd(rows: DataFrame, nowcast: DataFrame, params: ReportParams) -> DataFrame:
    """Registered by the cut-off's day of each year, plus the late part, for all measures at once.

    Past years compare with what happened up to that day, the current year with the nowcast (a daily
    table); the first year shows no late part. Growth is measured against the current year.
    """
    rows = rows.where(in_years(F.col("fecha"), params.years))
    registered = registered_in_time(F.col("fecha"), _registered_date(), params.cutoff)
    occurred = _is_past(params) & up_to_same_day(F.col("fecha"), params.cutoff)
    projection = _projection(nowcast, params.current_year_start, params.cutoff, params)
    return _decompose(_per_year(rows, registered, occurred), projection, params, growth_on_current)


def late_registration_month(rows: DataFrame, nowcast: DataFrame, params: ReportParams) -> DataFrame:
    """The same decomposition for the events of one month, past years and nowcast taken whole.

    The first year counts only events and registrations up to ``first_year_day``. Growth is measured
    against the previous year.
    """
    event, registered_on = F.col("fecha"), _registered_date()
    rows = rows.where(in_month(event, params.years, params.month))
    is_first = F.year(event) == params.first_year
    registered = (F.year(registered_on) == F.year(event)) & F.when(
        is_first, registered_on <= _first_year_limit(params)
    ).otherwise(up_to_same_day(registered_on, params.cutoff))
    occurred = _is_past(params) & (~is_first | (event <= _first_year_limit(params)))
    projection = _projection(nowcast, params.month_start, params.month_end, params)
    return _decompose(_per_year(rows, registered, occurred), projection, params, growth_on_reference)
