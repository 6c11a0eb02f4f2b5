"""Worst performers: facilities by surgeries against the target due so far, and paging of ranked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import null_safe_join, require_unique, sum_or_zero
from tidemark.functions.dates import in_years
from tidemark.functions.numbers import ratio
from tidemark.functions.ranking import Order, global_row_number
from tidemark.functions.text import facility_name
from tidemark.operators.fact import exclude_listed, exclude_values
from tidemark.params import ReportParams

def surgery_progress(
    rows: DataFrame,
    facilities: DataFrame,
    targets: DataFrame,
    excluded: DataFrame,
    params: ReportParams,
    hospitals_only: bool = False,
) -> DataFrame:
    """Surgeries of the current year per facility against the share of its target due by the report week.

    Activity is reduced to one row per facility before any join. Facilities without a surgery target or on
    the excluded list are left out; ``hospitals_only`` also drops the excluded and missing categories.
    """
    per_facility = (
        rows.where(in_years(F.col("fecha"), [params.current_year]))
        .groupBy("clues")
        .agg(sum_or_zero(F.col("procedimientos_quirurgicos")).cast("bigint").alias("avance"))
    )
    described = require_unique(
        facilities.select(F.col("clues_imb").alias("clues"), "nombre_comercial", "entidad", "categoria_gerencial"),
        "clues",
        "facility catalogue",
        null_safe=True,
    )
    if hospitals_only:
        described = exclude_values(described, "categoria_gerencial", params.excluded_categories)
        described = described.where(F.col("categoria_gerencial").isNotNull())
    goals = require_unique(
        targets.select(F.col("clues_imb").alias("clues"), "meta_cirugia_anual"), "clues", "targets", null_safe=True
    ).where(F.col("meta_cirugia_anual") > 0)
    # A missing category drops the facility, so the hospital table can join inner; so can the targets.
    kept = null_safe_join(per_facility, described, ["clues"], "inner" if hospitals_only else "left")
    kept = null_safe_join(kept, goals, ["clues"], "inner")
    kept = exclude_listed(kept, "clues", excluded, "clues_imb_hbc")
    due = F.col("meta_cirugia_anual") * F.lit(params.target_share)
    return kept.select(
        "clues",
        facility_name(F.col("nombre_comercial")).alias("nombre_unidad"),
        "entidad",
        "avance",
        due.alias("_due"),
        ratio(F.col("avance"), due).alias("_ratio"),
    )


def _rank(progress: DataFrame) -> DataFrame:
    # Equal ratios reached by different divisions may differ in the last bit, hence the rounding.
    order = [Order(F.round("_ratio", 9)), Order(F.col("clues"))]
    ranked = global_row_number(progress, order)
    return ranked.select(
        "posicion",
        "clues",
        "nombre_unidad",
        "entidad",
        "avance",
        F.bround("_due", 0).alias("meta_acumulada"),
        F.bround(F.col("_ratio") * 100, 1).alias("cumplimiento_pct"),
    )


def surgery_ranking(progress: DataFrame) -> DataFrame:
    """All facilities, worst attainment first."""
    return _rank(progress)


def surgery_zero_progress(ranking: DataFrame) -> DataFrame:
    """Facilities without any surgery, keeping their rank among all."""
    return ranking.where(F.col("avance") == 0)


def surgery_low_performers(progress: DataFrame, params: ReportParams, threshold: float | None = None) -> DataFrame:
    """Facilities at or below a share of the expected progress, ranked among themselves."""
    limit = params.target_share * params.low_performer_factor if threshold is None else threshold
    return _rank(progress.where(F.col("_ratio") <= F.lit(limit)))


def fixed_pages(ranked: DataFrame, params: ReportParams, position: str = "posicion") -> DataFrame:
    """A first page of fixed size and the rest; a short table leaves the second page empty."""
    return ranked.withColumn("pagina", F.when(F.col(position) <= params.page_size, 1).otherwise(2))


def half_pages(ranked: DataFrame, position: str = "posicion") -> DataFrame:
    """Two pages of equal length, the first taking the odd row. ``position`` numbers the rows 1..n."""
    # The largest position is the row count; as a scalar subquery it needs neither a join nor a window.
    size = ranked.agg(F.max(position)).scalar()
    return ranked.withColumn(
        "pagina", F.when(F.col(position) <= F.ceil(size / F.lit(2.0)), 1).otherwise(2)
    )


def first_rows(ranked: DataFrame, count: int, position: str = "posicion") -> DataFrame:
    """The top of a ranked table: its position already says which rows these are."""
    return ranked.where(F.col(position) <= count)
