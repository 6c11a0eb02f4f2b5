"""Nowcast output: daily totals, observed against modelled per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import strict_sum, strict_sum_if, sum_or_zero
from tidemark.functions.dates import as_day, between_days
from tidemark.functions.text import state_name
from tidemark.operators.fact import exclude_values
from tidemark.params import METRICS, ReportParams

# Nowcast type behind each measure; total visits are the sum of the first two.
NOWCAST_TYPES = {
    "consultas_generales": "general",
    "consultas_de_especialidad": "especialidad",
    "procedimientos_quirurgicos": "qx",
    "egresos": "egresos",
}


def _by_type(value: str) -> dict[str, Column]:
    """Strict sum of a value per measure. A missing type counts 0, a missing value makes the sum NULL."""
    sums = {m: strict_sum_if(F.col("tipo_consulta") == t, F.col(value)) for m, t in NOWCAST_TYPES.items()}
    total = sums["consultas_generales"] + sums["consultas_de_especialidad"]
    return {"consultas_totales": total, **sums}


def _dated(nowcast: DataFrame) -> DataFrame:
    return nowcast.withColumn("fecha", as_day(nowcast, "dia"))


def nowcast_daily(nowcast: DataFrame, params: ReportParams) -> DataFrame:
    """Modelled value of each measure per day of the current year onwards; ``nowcast_as_of`` can cut it."""
    rows = _dated(nowcast).where(F.col("fecha") >= F.lit(params.current_year_start))
    if params.nowcast_as_of is not None:
        rows = rows.where(F.col("fecha") <= F.lit(params.nowcast_as_of))
    sums = _by_type("nowcast")
    return rows.groupBy("fecha").agg(*[sums[m].alias(m) for m in METRICS])


def nowcast_total(daily: DataFrame) -> DataFrame:
    """Grand total of a daily nowcast; days without a value are skipped."""
    return daily.agg(*[sum_or_zero(F.col(m)).cast("double").alias(m) for m in METRICS])


def nowcast_weekly(daily: DataFrame) -> DataFrame:
    """Modelled value per calendar year and ISO week; one missing day makes the week NULL."""
    return daily.groupBy(F.year("fecha").alias("anio"), F.weekofyear("fecha").alias("semana")).agg(
        *[strict_sum(F.col(m)).alias(m) for m in METRICS]
    )


def nowcast_by_state(nowcast: DataFrame, params: ReportParams) -> DataFrame:
    """Observed, modelled and difference per state from the year's start to the cut-off."""
    rows = _dated(nowcast).where(between_days(F.col("fecha"), params.current_year_start, params.cutoff))
    observed, modelled = _by_type("observadas"), _by_type("nowcast")
    states = (
        rows.groupBy("entidad")
        .agg(
            *[observed[m].alias(f"{m}_observadas") for m in METRICS],
            *[modelled[m].alias(f"{m}_nowcast") for m in METRICS],
        )
        .withColumn("entidad", state_name(F.col("entidad")))
    )
    gaps = [(F.col(f"{m}_nowcast") - F.col(f"{m}_observadas")).alias(f"{m}_diferencias") for m in METRICS]
    return exclude_values(states.select("*", *gaps), "entidad", params.excluded_nowcast_states)
