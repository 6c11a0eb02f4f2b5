"""Texts of a report run and text clean-up tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import (
    report_week,
    target_share,
    wednesday_before,
    wednesday_on_or_before,
    week_start,
    years_back,
)
from tidemark.functions.numbers import compact_thousands, percent_label, ratio, short_scale, thousands
from tidemark.functions.text import facility_name, month_name, sentence_case, slug, state_name
from tidemark.params import WEEKS_PER_YEAR


def _day(date: Column) -> Column:
    return F.lpad(F.dayofmonth(date).cast("string"), 2, "0")


def _day_of_month(date: Column) -> Column:
    return F.concat(_day(date), F.lit(" de "), month_name(date))


def _with_year(date: Column) -> Column:
    return F.concat(_day_of_month(date), F.lit(" "), F.year(date).cast("string"))


def report_labels(run_dates: DataFrame, title: str = "Consultas totales", first_year: int = 2023) -> DataFrame:
    """Cut-off, week and every title of a report run on each given date (column ``hoy``)."""
    dates = (
        run_dates.withColumn("fecha_corte", wednesday_before(F.col("hoy")))
        .withColumn("miercoles", wednesday_on_or_before(F.col("hoy")))
        .withColumn("inicio_semana", week_start(F.col("fecha_corte")))
        .withColumn("num_semana", report_week(F.col("fecha_corte")))
    )
    corte, start, wednesday = F.col("fecha_corte"), F.col("inicio_semana"), F.col("miercoles")
    week = F.col("num_semana").cast("string")
    from_day = F.when(F.month(start) == F.month(corte), _day(start)).otherwise(_day_of_month(start))
    last_year = F.year(wednesday)
    return dates.select(
        "hoy",
        "fecha_corte",
        "miercoles",
        "inicio_semana",
        F.last_day(corte).alias("fin_mes"),
        years_back(corte, 1).alias("fecha_corte_1"),
        years_back(corte, 2).alias("fecha_corte_2"),
        years_back(corte, 3).alias("fecha_corte_3"),
        F.col("num_semana").cast("bigint").alias("num_semana"),
        target_share(F.col("num_semana")).alias("meta_hoy"),
        (F.col("num_semana") * F.lit(100.0) / F.lit(float(WEEKS_PER_YEAR))).alias("pct_al_dia"),
        F.date_format(corte, "dd_MM_yyyy").alias("fecha_corte_archivo"),
        month_name(corte).alias("mes_grafica_nombre"),
        # The wording of the report's texts, here and in the titles below.
        F.concat(
            F.lit("Semana del "), from_day, F.lit(" al "), _day_of_month(corte), F.lit(" (semana "), week, F.lit(")")
        ).alias("fecha_portada"),
        F.concat(F.lit("Al corte de "), _with_year(corte)).alias("fecha_valuebox"),
        F.concat(F.lit("Al "), sentence_case(_with_year(wednesday))).alias("fecha_txt"),
        F.concat(
            F.lit(f"{title} del 01 de enero al "),
            sentence_case(_day_of_month(wednesday)),
            F.lit(f" ({first_year}-"),
            last_year.cast("string"),
            F.lit(")"),
        ).alias("titulo_acumulado"),
        F.concat(
            F.lit("Proyección de "),
            F.lower(F.lit(title)),
            F.lit(" para "),
            F.lower(F.concat(month_name(wednesday), F.lit(" "), last_year.cast("string"))),
            F.lit(" y tendencia "),
            F.lower(month_name(wednesday)),
            F.lit(f" ({first_year}-"),
            (last_year - 1).cast("string"),
            F.lit(")"),
        ).alias("titulo_mes"),
        slug(F.lit(title)).alias("slug_titulo"),
    )


def number_labels(totals: DataFrame, key: str, value: str, whole: Column) -> DataFrame:
    """A value per key in every number format used by the reports, and its share of ``whole``."""
    number = F.col(value)
    return totals.select(
        key,
        number.alias("valor"),
        thousands(number).alias("entero"),
        short_scale(number).alias("abreviado"),
        compact_thousands(number).alias("miles"),
        percent_label(ratio(number, whole)).alias("porcentaje"),
    )


def normalize_names(facilities: DataFrame) -> DataFrame:
    """State and facility display names of a catalogue."""
    return facilities.select(
        "clues_imb",
        state_name(F.col("entidad")).alias("entidad"),
        facility_name(F.col("nombre_comercial")).alias("nombre_unidad"),
    )
