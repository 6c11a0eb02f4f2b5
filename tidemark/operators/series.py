"""Charted series: monthly points and bands, observed and modelled parts, year-on-year components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import melt
from tidemark.functions.dates import as_day, between_days
from tidemark.functions.numbers import floor_at_zero, growth_on_reference, thousands
from tidemark.functions.text import MONTHS
from tidemark.operators.late import LATE_LABEL, projection_label
from tidemark.params import METRICS, ReportParams


def _in_range(series: DataFrame, params: ReportParams) -> DataFrame:
    dated = series.withColumn("fecha", as_day(series, "fecha"))
    return dated.where(between_days(F.col("fecha"), params.series_start, params.series_end))


def period_bands(series: DataFrame, params: ReportParams, value: str = "consultas_totales") -> DataFrame:
    """Each date of a series with the labelled interval it falls in, label height and the series' extremes.

    The intervals are constants, so the lookup is an expression over each row and needs no range join.
    """
    rows = _in_range(series, params)
    band = F.lit(None)
    for number, b in reversed(list(enumerate(params.bands, start=1))):
        struct = F.struct(
            F.lit(number).alias("banda"), F.lit(b.label).alias("etiqueta"), F.lit(b.label_height).alias("altura")
        )
        band = F.when(between_days(F.col("fecha"), b.start, b.end), struct).otherwise(band)
    # A series has a row a month, so one window over all of it reads it once and is small.
    whole = Window.partitionBy()
    top, bottom = F.max(value).over(whole), F.min(value).over(whole)
    return rows.withColumn("_band", band).select(
        "fecha",
        value,
        "_band.banda",
        "_band.etiqueta",
        (top * F.col("_band.altura")).alias("y_etiqueta"),
        bottom.alias("minimo"),
        top.alias("maximo"),
    )


def anniversary_points(series: DataFrame, params: ReportParams, value: str = "consultas_totales") -> DataFrame:
    """The points of one month in every year but the last date, and one row of the last date, with labels.

    Of several rows of the last date the one with the largest value stays.
    """
    rows = _in_range(series, params).select("fecha", value)
    # A row a month: the window is small, and the series is read once.
    backwards = Window.orderBy(F.col("fecha").desc(), F.col(value).desc_nulls_last())
    placed = rows.select("*", F.row_number().over(backwards).alias("_place"), F.max("fecha").over(backwards).alias("_end"))
    earlier = (F.month("fecha") == params.anniversary_month) & (F.col("fecha") < F.col("_end"))
    marked = placed.withColumn("_last", F.col("_place") == 1).where(F.col("_last") | earlier)
    month = MONTHS[params.anniversary_month - 1]
    label = F.concat(thousands(F.bround(value, 0)), F.lit(f"\n{month} "), F.year("fecha").cast("string"))
    return marked.select(
        "fecha",
        value,
        F.when(F.col("_last"), "ultimo").otherwise("aniversario").alias("tipo"),
        label.alias("etiqueta"),
    )


def actual_vs_model(
    observed: DataFrame,
    model: DataFrame,
    params: ReportParams,
    metrics: Sequence[str] = METRICS,
    model_label: str = "Meta junio",
) -> DataFrame:
    """Stacked parts per measure and year: past totals, this year's observed part and what the model adds.

    ``observed`` holds observed values per year, ``model`` one row of modelled values of the current year.
    """
    current = params.current_year
    seen = observed.select("anio", *[F.col(m).cast("double").alias(f"_obs_{m}") for m in metrics])
    modelled = model.select(
        F.lit(current).alias("anio"), *[F.col(m).cast("double").alias(f"_mod_{m}") for m in metrics]
    )
    # One row per year on either side, merged by a small aggregation.
    years = (
        seen.unionByName(modelled, allowMissingColumns=True)
        .groupBy("anio")
        .agg(*[F.expr(f"max({side}{m}) as {side}{m}") for side in ("_obs_", "_mod_") for m in metrics])
    )
    cells = {m: {"_obs": F.col(f"_obs_{m}"), "_mod": F.col(f"_mod_{m}")} for m in metrics}
    is_current = F.col("anio") == current

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("tipo"), value.alias("valor"))

    parts = F.when(
        is_current,
        F.array(
            part(f"Observado {current}", F.col("_obs")), part(model_label, F.col("_mod") - F.col("_obs"))
        ),
    ).otherwise(F.array(part("Histórico", F.col("_obs"))))
    stacked = melt(years, ["anio"], cells, "procedimiento").select(
        F.col("anio").cast("string").alias("anio"), "procedimiento", F.inline(parts)
    )
    # Each window partition is one bar: at most two parts.
    bar = Window.partitionBy("procedimiento", "anio")
    return stacked.withColumn("total_anio", F.coalesce(F.sum("valor").over(bar), F.lit(0.0)))


def yoy_lag(
    table: DataFrame,
    params: ReportParams,
    total: str = "valor",
    observed: str = "valor_fecha_insert",
    upper: str = "diferencia",
) -> DataFrame:
    """Observed and upper part per year, name of the upper part, label heights and growth on the year before."""
    # Each window partition holds one row per year of a measure.
    by_year = Window.partitionBy("procedimiento").orderBy("anio")
    whole = Window.partitionBy("procedimiento")
    value, seen = F.col(total).cast("double"), F.col(observed).cast("double")
    return table.select(
        "procedimiento",
        "anio",
        value.alias("total"),
        seen.alias("observado"),
        floor_at_zero(F.col(upper).cast("double")).alias("superior"),
        F.when(F.col("anio") == params.current_year, projection_label(params.current_year))
        .otherwise(LATE_LABEL)
        .alias("componente_superior"),
        growth_on_reference(value, F.lag(value).over(by_year)).alias("pct_cambio"),
        (value + F.max(value).over(whole) * 0.035).alias("y_total"),
        F.when(seen > 0, seen / F.lit(2.0)).alias("y_observado"),
    )
