"""Named queries over the star-schema tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fact, kpi, labels, nowcast, ranking, series, totals, weekly
from tidemark.operators.incremental import FactStore
from tidemark.operators.totals import DayWindow
from tidemark.plans.report import Report, count_sections, write_fact, write_report
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.sources.starschema import PARAMS, StarSchemaInputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Report], DataFrame]) -> Callable[[Report], DataFrame]:
    """Register a query under its function's name; it receives a lazy report over the given folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Report(StarSchemaInputs(spark, sf_dir), PARAMS))

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return build


# -- sources, dimensions, fact ---------------------------------------------------------------------------


@_query
def dim_facility(r: Report) -> DataFrame:
    return r.facilities()


@_query
def dim_targets(r: Report) -> DataFrame:
    return r.targets()


@_query
def normalize_names(r: Report) -> DataFrame:
    # The stored names are one word each; a longer one is made of them to show the word rules.
    name = F.concat(F.lit("HG SAN-"), F.col("entidad"), F.lit(" IMSS "), F.col("nombre_comercial"))
    return labels.normalize_names(r.inputs.catalog.withColumn("nombre_comercial", name))


@_query
def exclude_list(r: Report) -> DataFrame:
    kept = fact.exclude_values(r.facilities(), "entidad", ["Nation_7", "Nation_12"])
    kept = fact.exclude_values(kept, "categoria_gerencial", PARAMS.excluded_categories)
    return fact.exclude_listed(kept, "clues_imb", r.inputs.excluded, "clues_imb_hbc")


@_query
def fact_history(r: Report) -> DataFrame:
    return fact.fact_history(r.inputs, PARAMS)


@_query
def scan_union_by_name(r: Report) -> DataFrame:
    """Past-year visits delivered as four files, one of them without the visit type, scanned as one table."""
    spark = r.inputs.visits.sparkSession
    root = scratch_path(spark, "visit-files")
    delivered = r.inputs.visit_sources
    typed = delivered.where(F.col("archivo") != 0)
    typed.write.partitionBy("archivo").parquet(f"{root}/typed")
    delivered.where(F.col("archivo") == 0).drop("archivo", "tipo_consulta").write.parquet(f"{root}/untyped")
    paths = [f"{root}/typed/archivo={i}" for i in (1, 2, 3)] + [f"{root}/untyped"]
    return fact.daily_visits(files.scan_union_by_name(spark, paths), PARAMS)


@_query
def daily_visits(r: Report) -> DataFrame:
    return fact.daily_visits(r.inputs.visits, PARAMS)


@_query
def daily_surgeries(r: Report) -> DataFrame:
    return fact.daily_surgeries(r.inputs.surgeries, PARAMS)


@_query
def daily_discharges(r: Report) -> DataFrame:
    return fact.daily_discharges(r.inputs.discharges, PARAMS)


@_query
def fact_current(r: Report) -> DataFrame:
    return fact.fact_current(r.inputs, PARAMS)


@_query
def fact_daily(r: Report) -> DataFrame:
    return fact.fact_daily(r.inputs, PARAMS)


@_query
def fact_daily_fulljoin(r: Report) -> DataFrame:
    return fact.fact_daily_fulljoin(r.inputs, PARAMS)


@_query
def bitemporal_summary(r: Report) -> DataFrame:
    return fact.bitemporal_summary(r.activity())


@_query
def fact_ordered(r: Report) -> DataFrame:
    """The fact as a report writes it, in order of year and facility, read back."""
    spark = r.inputs.visits.sparkSession
    return write_fact(r.inputs, PARAMS, scratch_path(spark, "fact-ordered"))


@_query
def incremental_summary(r: Report) -> DataFrame:
    """The bi-temporal summary from a store that several runs have kept up, each reading what was new to it."""
    spark = r.inputs.visits.sparkSession
    store = FactStore(spark, scratch_path(spark, "fact-store"))
    for cutoff in (date(2000, 1, 31), date(2000, 3, 31), date(2000, 6, 7), PARAMS.cutoff):
        store.load(r.inputs, replace(PARAMS, cutoff=cutoff))
    return store.summary()


# -- yearly totals ---------------------------------------------------------------------------------------


@_query
def same_day_cutoff(r: Report) -> DataFrame:
    return totals.same_day_cutoff(r.activity(), PARAMS)


@_query
def as_registered(r: Report) -> DataFrame:
    return totals.as_registered(r.activity(PARAMS.years), PARAMS)


@_query
def ytd_by_year(r: Report) -> DataFrame:
    return r.ytd_by_year()


@_query
def year_totals(r: Report) -> DataFrame:
    return r.year_totals()


@_query
def ytd_share_of_year(r: Report) -> DataFrame:
    return r.ytd_share_of_year()


@_query
def persons_pivot(r: Report) -> DataFrame:
    return totals.persons_pivot(r.inputs.persons, PARAMS)


@_query
def persons_by_year(r: Report) -> DataFrame:
    return r.persons_by_year()


@_query
def period_summary(r: Report) -> DataFrame:
    return totals.period_summary(
        r.activity(PARAMS.years), date(2000, 3, 1), PARAMS.cutoff, PARAMS.years, force_equal_years=(1998,)
    )


@_query
def sum_periods(r: Report) -> DataFrame:
    """May, June and July added up: July has not happened yet in the current year."""
    months = [
        DayWindow("mayo", date(2000, 5, 1), date(2000, 5, 31)),
        DayWindow("junio", date(2000, 6, 1), date(2000, 6, 30)),
        DayWindow("julio", date(2000, 7, 1), date(2000, 7, 31)),
    ]
    summaries = totals.window_summaries(r.activity(PARAMS.years), months, PARAMS.years)
    return totals.sum_periods(summaries, len(months))


@_query
def late_registration_ytd(r: Report) -> DataFrame:
    return r.late_registration_ytd()


@_query
def late_registration_month(r: Report) -> DataFrame:
    return r.late_registration_month()


# -- weekly series ---------------------------------------------------------------------------------------


@_query
def weekly_real(r: Report) -> DataFrame:
    return weekly.weekly_real(r.activity(PARAMS.recent_years), PARAMS)


@_query
def weekly_nowcast(r: Report) -> DataFrame:
    return nowcast.nowcast_weekly(r.nowcast_daily())


@_query
def weekly_series(r: Report) -> DataFrame:
    return r.weekly_series()


@_query
def weekly_registered(r: Report) -> DataFrame:
    return weekly.weekly_registered(r.activity(PARAMS.recent_years), PARAMS)


@_query
def weekly_series_registered(r: Report) -> DataFrame:
    return r.weekly_series_registered()


@_query
def custom_week(r: Report) -> DataFrame:
    return weekly.custom_weeks(r.activity(PARAMS.recent_years), PARAMS)


@_query
def week_month_spans(r: Report) -> DataFrame:
    return weekly.week_month_spans(fact.activity_years(r.inputs, PARAMS))


@_query
def last_point_per_year(r: Report) -> DataFrame:
    return weekly.last_point_per_year(r.weekly_series())


@_query
def label_spacing(r: Report) -> DataFrame:
    return r.label_spacing()


# -- nowcast, targets, states ----------------------------------------------------------------------------


@_query
def nowcast_daily(r: Report) -> DataFrame:
    return r.nowcast_daily()


@_query
def nowcast_by_state(r: Report) -> DataFrame:
    return r.nowcast_by_state()


@_query
def targets_by_state(r: Report) -> DataFrame:
    return r.targets_by_state()


@_query
def attainment_by_state(r: Report) -> DataFrame:
    return r.attainment_by_state()


@_query
def attainment_observed(r: Report) -> DataFrame:
    return r.attainment_observed()


@_query
def state_year_registered(r: Report) -> DataFrame:
    return r.state_year_registered()


@_query
def traffic_light(r: Report) -> DataFrame:
    return r.traffic_light()


@_query
def axis_stats(r: Report) -> DataFrame:
    return r.axis_stats()


@_query
def global_progress(r: Report) -> DataFrame:
    return r.global_progress()


@_query
def paged_table(r: Report) -> DataFrame:
    return r.global_progress_pages().select("pagina", "posicion", "entidad", "avance_global")


# -- facility rankings -----------------------------------------------------------------------------------


@_query
def surgery_ranking(r: Report) -> DataFrame:
    return r.surgery_ranking()


@_query
def surgery_worst_ten(r: Report) -> DataFrame:
    return ranking.first_rows(r.surgery_ranking(), 10)


@_query
def surgery_zero_progress(r: Report) -> DataFrame:
    return r.surgery_zero_progress()


@_query
def surgery_low_performers(r: Report) -> DataFrame:
    return r.surgery_low_performers()


# -- KPIs and labels -------------------------------------------------------------------------------------


@_query
def kpi_wide(r: Report) -> DataFrame:
    return r.kpi_wide()


@_query
def growth_wide(r: Report) -> DataFrame:
    return r.growth_wide()


@_query
def growth_ytd(r: Report) -> DataFrame:
    return r.growth_ytd()


@_query
def growth_ref_base(r: Report) -> DataFrame:
    return kpi.growth_ref_base(r.late_registration_month(), "total_graf", PARAMS)


@_query
def kpi_cards(r: Report) -> DataFrame:
    return r.kpi_cards()


@_query
def delta_text(r: Report) -> DataFrame:
    return r.delta_text()


@_query
def progress_summary(r: Report) -> DataFrame:
    return r.progress_summary()


@_query
def indicator_growth_table(r: Report) -> DataFrame:
    return r.indicator_growth_table()


@_query
def number_labels(r: Report) -> DataFrame:
    """Scaled-up visit totals per facility in every number format."""
    visits = (F.sum("consultas_totales") * 1375).alias("consultas_totales")
    per_facility = r.facility_activity().groupBy("clues").agg(visits)
    # The grand total is one number, read as a scalar subquery over the same per-facility totals.
    whole = per_facility.agg(F.sum("consultas_totales")).scalar()
    return labels.number_labels(per_facility, "clues", "consultas_totales", whole)


@_query
def report_labels(r: Report) -> DataFrame:
    """Texts of a report run on each day on which activity happened."""
    recorded = r.inputs.visits.select(F.col("fecha_consulta").cast("date").alias("hoy"))
    days = recorded.union(r.inputs.history_rows.select("fecha")).distinct()
    return labels.report_labels(days, first_year=PARAMS.first_year)


# -- charted series --------------------------------------------------------------------------------------


@_query
def actual_vs_model(r: Report) -> DataFrame:
    return r.actual_vs_model()


@_query
def period_bands(r: Report) -> DataFrame:
    return r.period_bands()


@_query
def anniversary_points(r: Report) -> DataFrame:
    return r.anniversary_points()


@_query
def yoy_lag(r: Report) -> DataFrame:
    summary = totals.period_summary(r.activity(PARAMS.years), date(2000, 1, 1), PARAMS.cutoff, PARAMS.years)
    return series.yoy_lag(summary, PARAMS)


@_query
def report_datasets(r: Report) -> DataFrame:
    """Write the whole report below the shared folder and count the rows of every section read back."""
    spark = r.inputs.visits.sparkSession
    root = scratch_path(spark, "report")
    return count_sections(spark, root, PARAMS, write_report(r.inputs, PARAMS, root))
