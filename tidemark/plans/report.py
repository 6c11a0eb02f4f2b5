"""The whole report as a set of written datasets."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import in_years, up_to_same_day
from tidemark.functions.text import MONTHS
from tidemark.operators import attainment, fact, kpi, late, nowcast, ranking, series, totals, views, weekly
from tidemark.operators.incremental import FactStore
from tidemark.params import METRIC_TITLES, METRICS, PERSON_METRICS, ReportParams
from tidemark.sources.inputs import ReportInputs
from tidemark.sources.sinks import ReportSink, ordered, read_section

ALL_MEASURES = (*METRICS, *PERSON_METRICS)


class Report:
    """Every report dataset as a lazy DataFrame over one set of inputs.

    By default datasets are computed straight from the record scans. Once written, ``fact_table`` (partitioned
    by ``anio``) serves the datasets that look at facilities and ``summary_table`` (the same without
    facilities) all others. Both have ``periodo`` and undated rows, which only totals of file years look at.
    """

    def __init__(
        self,
        inputs: ReportInputs,
        params: ReportParams,
        fact_table: DataFrame | None = None,
        summary_table: DataFrame | None = None,
    ):
        self.inputs = inputs
        self.params = params
        self._fact_table = fact_table
        self._summary_table = summary_table

    def activity(self, years=None) -> DataFrame:
        """Activity for datasets that do not look at facilities."""
        if self._summary_table is not None:
            return self._summary_table.where(F.col("fecha").isNotNull()).drop("periodo")
        return self.facility_activity(years)

    def activity_by_file(self, years=None) -> DataFrame:
        """Activity with the year of each row's file, undated rows included."""
        if self._summary_table is not None:
            return self._summary_table
        return fact.activity_by_file(self.inputs, self.params, years)

    def facility_activity(self, years=None) -> DataFrame:
        if self._fact_table is None:
            return fact.activity(self.inputs, self.params, years)
        # Either condition prunes partitions.
        wanted = F.col("anio").isNotNull() if years is None else F.col("anio").isin(*years)
        return self._fact_table.where(wanted).drop("anio", "periodo")

    # -- dimensions, targets, nowcast ----------------------------------------------------------------

    def facilities(self) -> DataFrame:
        return fact.dim_facility(self.inputs.catalog, self.params)

    def targets(self) -> DataFrame:
        return fact.dim_targets(self.inputs.targets, self.params)

    def targets_by_state(self) -> DataFrame:
        return attainment.targets_by_state(self.targets())

    def nowcast_daily(self) -> DataFrame:
        return nowcast.nowcast_daily(self.inputs.nowcast_national, self.params)

    def nowcast_daily_all_states(self) -> DataFrame:
        return nowcast.nowcast_daily(self.inputs.nowcast_state, self.params)

    def nowcast_by_state(self) -> DataFrame:
        return nowcast.nowcast_by_state(self.inputs.nowcast_state, self.params)

    # -- yearly totals -------------------------------------------------------------------------------

    def persons_by_year(self) -> DataFrame:
        return totals.persons_by_year(totals.persons_pivot(self.inputs.persons, self.params))

    def ytd_by_year(self) -> DataFrame:
        return totals.ytd_by_year(self.activity(), self.params)

    def year_totals(self) -> DataFrame:
        """All that the files of each recent year hold."""
        years = self.params.recent_years
        return totals.file_year_totals(self.activity_by_file(years), years)

    def ytd_share_of_year(self) -> DataFrame:
        return totals.ytd_share_of_year(self.activity(self.params.recent_years), self.params)

    # -- late registration ---------------------------------------------------------------------------

    def late_registration_ytd(self) -> DataFrame:
        rows = self.activity(self.params.years)
        return late.late_registration_ytd(rows, self.nowcast_daily_all_states(), self.params)

    def late_registration_month(self) -> DataFrame:
        rows = self.activity(self.params.years)
        return late.late_registration_month(rows, self.nowcast_daily_all_states(), self.params)

    # -- weekly series -------------------------------------------------------------------------------

    def weekly_series(self) -> DataFrame:
        past = self.params.recent_years[:-1]
        real = weekly.weekly_real(self.activity(past), self.params)
        return weekly.weekly_series(real, nowcast.nowcast_weekly(self.nowcast_daily()), self.params)

    def weekly_series_registered(self) -> DataFrame:
        rows = self.activity(self.params.recent_years)
        return weekly.weekly_series_registered(weekly.weekly_registered(rows, self.params), self.params)

    def label_spacing(self) -> DataFrame:
        return weekly.label_spacing(self.weekly_series(), self.params)

    # -- KPIs ----------------------------------------------------------------------------------------

    def kpi_wide(self) -> DataFrame:
        return kpi.kpi_wide(self.ytd_by_year(), self.nowcast_daily(), self.persons_by_year(), self.params)

    def growth(self, measures=ALL_MEASURES) -> DataFrame:
        """Growth needs the reference years alone, the current one being modelled: no other year is read."""
        years = self.params.growth_reference_years
        ytd = totals.ytd_by_year(self.activity(years), self.params, years)
        wide = kpi.kpi_wide(ytd, self.nowcast_daily(), self.persons_by_year(), self.params)
        return kpi.growth_long(wide, measures, self.params)

    def growth_wide(self) -> DataFrame:
        return kpi.growth_wide(self.growth(), ALL_MEASURES, self.params)

    def growth_to_cutoff(self) -> DataFrame:
        """Growth of as-occurred totals to the cut-off's day."""
        return kpi.growth_long(kpi.to_cutoff(self.ytd_share_of_year()), METRICS, self.params)

    def growth_ytd(self) -> DataFrame:
        return kpi.growth_wide(self.growth_to_cutoff(), METRICS, self.params)

    def kpi_cards(self) -> DataFrame:
        return kpi.kpi_cards(self.growth())

    def delta_text(self) -> DataFrame:
        occurred = kpi.delta_text(self.growth(METRICS), self.params)
        to_cutoff = kpi.delta_text(self.growth_to_cutoff(), self.params)
        return occurred.withColumn("vista", F.lit("proyectado")).unionByName(
            to_cutoff.withColumn("vista", F.lit("al_corte"))
        )

    def progress_summary(self) -> DataFrame:
        """Occurred, registered and file-year totals are views of one scan of the activity."""
        params, past = self.params, self.params.recent_years[:-1]
        event, registered = F.col("fecha"), F.coalesce(F.col("fecha_insert"), F.col("fecha"))
        occurred = up_to_same_day(event, params.cutoff, past)
        in_time = in_years(event, params.recent_years) & totals.registered_in_time(event, registered, params.cutoff)
        yearly = views.compile_views(
            self.activity_by_file(params.recent_years),
            [
                views.View("ocurrido", "evento", occurred),
                views.View("registrado", "evento", in_time),
                views.View("archivo", "archivo", F.col("periodo").isin(*past)),
            ],
            {"evento": F.year(event), "archivo": F.col("periodo")},
            METRICS,
        )
        return kpi.progress_summary(kpi.progress_rows(yearly, self.nowcast_daily(), params), params)

    def indicator_growth_table(self) -> DataFrame:
        month = MONTHS[self.params.month - 1]
        text_year = F.concat(F.lit(f"Enero-{month} "), F.col("anio").cast("string"))
        years = self.params.years[-2:]
        ytd = totals.ytd_by_year(self.activity(years), self.params, years)
        return kpi.indicator_growth_table(
            ytd.withColumn("anio", text_year), METRIC_TITLES, month, self.params
        )

    def actual_vs_model(self) -> DataFrame:
        return series.actual_vs_model(
            self.ytd_by_year(), nowcast.nowcast_total(self.nowcast_daily()), self.params
        )

    # -- states --------------------------------------------------------------------------------------

    def attainment(self) -> DataFrame:
        return attainment.attainment(self.nowcast_by_state(), self.targets_by_state())

    def attainment_by_state(self) -> DataFrame:
        return attainment.attainment_by_state(self.attainment(), self.params)

    def traffic_light(self) -> DataFrame:
        return attainment.traffic_light(self.attainment(), self.params)

    def axis_stats(self) -> DataFrame:
        return attainment.axis_stats(self.attainment(), self.params)

    def state_year_registered(self) -> DataFrame:
        rows = self.facility_activity(self.params.recent_years)
        return attainment.state_year_registered(rows, self.targets(), self.params)

    def attainment_observed(self) -> DataFrame:
        states = self.state_year_registered().where(F.col("anio") == self.params.current_year)
        return attainment.attainment_observed(states)

    def global_progress(self) -> DataFrame:
        return attainment.global_progress(self.attainment(), self.params)

    def global_progress_pages(self) -> DataFrame:
        return ranking.half_pages(self.global_progress())

    # -- facilities ----------------------------------------------------------------------------------

    def _surgery_progress(self, hospitals_only: bool) -> DataFrame:
        return ranking.surgery_progress(
            self.facility_activity([self.params.current_year]),
            self.facilities(),
            self.targets(),
            self.inputs.excluded,
            self.params,
            hospitals_only,
        )

    def surgery_ranking(self) -> DataFrame:
        return ranking.surgery_ranking(self._surgery_progress(hospitals_only=False))

    def surgery_zero_progress(self) -> DataFrame:
        return ranking.fixed_pages(ranking.surgery_zero_progress(self.surgery_ranking()), self.params)

    def surgery_low_performers(self) -> DataFrame:
        low = ranking.surgery_low_performers(self._surgery_progress(hospitals_only=True), self.params)
        return ranking.fixed_pages(low, self.params)

    # -- monthly series ------------------------------------------------------------------------------

    def period_bands(self) -> DataFrame:
        return series.period_bands(self.inputs.monthly_series, self.params)

    def anniversary_points(self) -> DataFrame:
        return series.anniversary_points(self.inputs.monthly_series, self.params)


# The datasets behind the report, in reading order.
SECTIONS: dict[str, Callable[[Report], DataFrame]] = {
    "kpi_cards": Report.kpi_cards,
    "attainment_by_state": Report.attainment_by_state,
    "axis_stats": Report.axis_stats,
    "progress_summary": Report.progress_summary,
    "delta_text": Report.delta_text,
    "weekly_series": Report.weekly_series,
    "label_spacing": Report.label_spacing,
    "late_registration_ytd": Report.late_registration_ytd,
    "late_registration_month": Report.late_registration_month,
    "global_progress": Report.global_progress_pages,
    "surgery_zero_progress": Report.surgery_zero_progress,
    "surgery_low_performers": Report.surgery_low_performers,
    "weekly_series_registered": Report.weekly_series_registered,
    "attainment_observed": Report.attainment_observed,
    "indicator_growth_table": Report.indicator_growth_table,
    "actual_vs_model": Report.actual_vs_model,
    "period_bands": Report.period_bands,
    "anniversary_points": Report.anniversary_points,
}


def write_fact(inputs: ReportInputs, params: ReportParams, path: str) -> DataFrame:
    """Write the daily fact, with the year of each row's file, partitioned by event year, and read it back.

    Later steps prune years by partition and never repeat the record scans; a lost executor costs a re-read,
    not a recomputation.
    """
    daily = fact.daily_by_file(inputs, params).withColumn("anio", F.year("fecha"))
    # Ranges of year and facility: a year is in few files, and a facility's rows are in one or two of them.
    ordered(daily, ["anio", "clues", "fecha", "fecha_insert"]).write.mode("overwrite").partitionBy("anio").parquet(path)
    return daily.sparkSession.read.parquet(path)


class StagedInputs(ReportInputs):
    """Inputs whose small tables several sections share were written once below ``path``."""

    SHARED = ("nowcast_state", "nowcast_national", "persons")

    def __init__(self, inputs: ReportInputs, path: str):
        self._inputs = inputs
        for name in self.SHARED:
            setattr(self, name, _write_and_read(getattr(inputs, name), f"{path}/{name}"))

    def __getattr__(self, name: str):
        return getattr(self._inputs, name)


def _write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(
    inputs: ReportInputs,
    params: ReportParams,
    root: str,
    sections: dict[str, Callable] | None = None,
    parallel_sections: int = 4,
    store: FactStore | None = None,
) -> list[str]:
    """Write the fact and its facility-free summary once, then every section; returns the section names.

    Record files and nowcasts are thus scanned once per report, and with a store only what was registered since the last
    run. Most sections need no facilities and read the summary, whose size depends on the days covered, not on the
    number of records. Sections are independent small jobs, so a few are submitted at a time. The report appears when
    all are written; the run's own tables go in any case.
    """
    sections = SECTIONS if sections is None else sections
    spark = inputs.catalog.sparkSession
    with ReportSink(spark, root).run(params.cutoff) as run:
        if store is None:
            rows = write_fact(inputs, params, f"{run.tables}/fact_daily")
        else:
            store.kept_up(inputs, params)
            rows = store.rows(as_of=params.cutoff)
        summary = _write_and_read(fact.without_facility(rows), f"{run.tables}/fact_summary")
        report = Report(StagedInputs(inputs, f"{run.tables}/shared"), params, rows, summary)

        def write(name: str) -> str:
            run.write(sections[name](report), name)
            return name

        with ThreadPoolExecutor(max_workers=parallel_sections) as pool:
            return list(pool.map(inheritable_thread_target(spark)(write), sections))


def count_sections(spark, root: str, params: ReportParams, names: list[str]) -> DataFrame:
    """Rows per written section, read back from disk."""
    counts = [
        read_section(spark, root, params.cutoff, name).agg(F.count(F.lit(1)).alias("filas"))
        .select(F.lit(name).alias("seccion"), "filas")
        for name in names
    ]
    combined = counts[0]
    for part in counts[1:]:
        combined = combined.unionByName(part)
    return combined
