"""The bi-temporal daily fact.

Every record contributes 1 to some of the five measures, and all measures only ever get added up. The
operators of this package therefore accept *activity* at any grain: single contributions straight from the
record scan, the daily fact, or the facility-free summary. Reports that need years or weeks aggregate the
contributions directly and shuffle a handful of rows; the fine-grained fact is built only where it is the
result, or once as a written table shared by many sections.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.aggregates import may_broadcast, null_safe_join, require_unique, sum_metrics
from tidemark.functions.dates import as_day, in_years
from tidemark.functions.text import state_name
from tidemark.params import METRICS, ReportParams
from tidemark.sources.files import union_by_name
from tidemark.sources.inputs import ReportInputs

KEYS = ("clues", "fecha", "fecha_insert")

# Spellings of the two classified visit types, and the spelling the current year's file uses.
GENERAL = ("general", "generales")
SPECIALTY = ("especialidad", "especialidades")


def clean_states(df: DataFrame, params: ReportParams) -> DataFrame:
    """Normalised state names without the excluded states; rows without a state stay."""
    named = df.withColumn("entidad", state_name(F.col("entidad")))
    return exclude_values(named, "entidad", params.excluded_states)


def exclude_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Drop rows whose value is listed; NULL is in no list."""
    values = list(values)
    if not values:
        return df
    return df.where(F.col(column).isNull() | ~F.col(column).isin(values))


def exclude_listed(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """Drop rows whose value occurs in another table; rows with NULL stay."""
    names = listed.select(F.col(listed_column).alias("_listed"))
    return df.join(names, F.col(column) == F.col("_listed"), "left_anti")


def dim_facility(catalog: DataFrame, params: ReportParams) -> DataFrame:
    return clean_states(catalog, params)


def dim_targets(targets: DataFrame, params: ReportParams) -> DataFrame:
    return clean_states(targets, params)


def resolve_facility_codes(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """Current facility code of every history row: kept if already current, else looked up, else dropped.

    While Spark would broadcast the crosswalk, by its own estimate and limit, rows are looked up where they are
    read. Beyond that the join shuffles, and then only sums of legacy rows per code and day: a facility that holds
    much of the history has collapsed by then, and rows under current codes stay where they are.
    """
    crosswalk = require_unique(
        catalog.select(
            F.col("clues_ssa_y_sme").cast("string").alias("_legacy"), F.col("clues_imb").cast("string").alias("_code")
        ).where(F.col("_legacy").isNotNull()),
        "_legacy",
        "facility crosswalk",
    )
    if may_broadcast(crosswalk):
        return _looked_up(history, crosswalk)
    # The join shuffles: current codes pass it by, and legacy rows are added up before they meet it.
    current = F.coalesce(F.col("clues").contains("IMB"), F.lit(False))
    measures = [c for c in METRICS if c in history.columns]
    keys = [c for c in history.columns if c not in measures]
    legacy = history.where(~current).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    return history.where(current).unionByName(_looked_up(legacy, crosswalk).select(*history.columns))


def _looked_up(history: DataFrame, crosswalk: DataFrame) -> DataFrame:
    joined = history.join(crosswalk, F.col("clues").cast("string") == F.col("_legacy"), "left")
    code = F.when(F.col("clues").contains("IMB"), F.col("clues")).otherwise(F.col("_code"))
    return joined.withColumn("clues", code).where(F.col("clues").isNotNull()).drop("_legacy", "_code")


def _resolved_history(history: DataFrame, inputs: ReportInputs, params: ReportParams) -> DataFrame:
    kept = history.where(F.col("anio") != params.first_record_year)
    kept = kept.select("clues", as_day(history, "fecha").alias("fecha"), *METRICS)
    return resolve_facility_codes(kept, dim_facility(inputs.catalog, params)).select("clues", "fecha", *METRICS)


def fact_history(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The history cube under current codes, without the year that the record files already cover."""
    return _resolved_history(inputs.history, inputs, params)


def _registered_by_cutoff(period: Column, registered: Column, params: ReportParams) -> Column:
    """Current-year files are cut at the report date, and drop unregistered rows; older files are whole."""
    return (period != params.current_year) | (registered <= F.lit(params.cutoff))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def _visit_flags(period: Column, params: ReportParams) -> dict[str, Column]:
    kind = F.lower(F.col("tipo_consulta"))
    is_current = period == params.current_year
    general = F.when(is_current, kind == GENERAL[0]).otherwise(kind.isin(*GENERAL))
    specialty = F.when(is_current, kind == SPECIALTY[0]).otherwise(kind.isin(*SPECIALTY))
    return {
        "consultas_totales": F.lit(1).cast("bigint"),
        "consultas_generales": _flag(general),
        "consultas_de_especialidad": _flag(specialty),
    }


def _contributions(records: DataFrame, date_name: str, flags: dict[str, Column], params: ReportParams) -> DataFrame:
    dated = records.withColumn("fecha_insert", as_day(records, "fecha_insert"))
    kept = dated.where(_registered_by_cutoff(F.col("periodo"), F.col("fecha_insert"), params))
    return kept.select(
        "clues",
        as_day(records, date_name).alias("fecha"),
        "fecha_insert",
        "periodo",
        *[flag.alias(name) for name, flag in flags.items()],
    )


def visit_contributions(visits: DataFrame, params: ReportParams) -> DataFrame:
    return _contributions(visits, "fecha_consulta", _visit_flags(F.col("periodo"), params), params)


def surgery_contributions(surgeries: DataFrame, params: ReportParams) -> DataFrame:
    return _contributions(surgeries, "fecha_egreso", {"procedimientos_quirurgicos": F.lit(1).cast("bigint")}, params)


def discharge_contributions(discharges: DataFrame, params: ReportParams) -> DataFrame:
    return _contributions(discharges, "fecha_egreso", {"egresos": F.lit(1).cast("bigint")}, params)


def record_contributions(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """Contributions of all records, from one scan when the inputs store the three kinds together."""
    joint = inputs.joint_records
    if joint is not None:
        flags = _visit_flags(F.col("periodo"), params)
        flags["procedimientos_quirurgicos"] = _flag(F.col("es_cirugia"))
        flags["egresos"] = _flag(F.col("es_egreso"))
        return _contributions(joint, "fecha_consulta", flags, params)
    return union_by_name(
        [
            visit_contributions(inputs.visits, params),
            surgery_contributions(inputs.surgeries, params),
            discharge_contributions(inputs.discharges, params),
        ]
    )


def daily(contributions: DataFrame) -> DataFrame:
    """Contributions summed per facility, event date and registration date."""
    metrics = [metric for metric in METRICS if metric in contributions.columns]
    return contributions.groupBy(*KEYS).agg(*sum_metrics(metrics))


def daily_by_file(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The daily fact with the year of the file as a further key, undated rows included."""
    return activity_by_file(inputs, params).groupBy(*KEYS, "periodo").agg(*sum_metrics(METRICS))


def daily_visits(visits: DataFrame, params: ReportParams) -> DataFrame:
    return daily(visit_contributions(visits, params))


def daily_surgeries(surgeries: DataFrame, params: ReportParams) -> DataFrame:
    return daily(surgery_contributions(surgeries, params))


def daily_discharges(discharges: DataFrame, params: ReportParams) -> DataFrame:
    return daily(discharge_contributions(discharges, params))


def zero_fill(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """NULL to 0 in every numeric column but those to keep."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keep]
    return df.fillna(0, subset=numeric)


def activity_by_file(inputs: ReportInputs, params: ReportParams, years: Iterable[int] | None = None) -> DataFrame:
    """All contributions on the fact's columns and ``periodo``, the year of the file each came from.

    The history cube is no file of a year: its ``periodo`` is NULL. Undated rows stay. ``years`` leaves out a source
    none of whose years is asked for, and no row of the others.
    """
    years = None if years is None else sorted(set(years))
    parts = []
    if years is None or years[0] <= params.history_last_year:
        parts.append(_resolved_history(inputs.history_rows, inputs, params))
    if years is None or years[-1] > params.history_last_year:
        parts.append(record_contributions(inputs, params))
    rows = zero_fill(union_by_name(parts), keep=("periodo",))
    for missing, kind in (("fecha_insert", "date"), ("periodo", "int")):
        if missing not in rows.columns:
            rows = rows.withColumn(missing, F.lit(None).cast(kind))
    return rows.select(*KEYS, "periodo", *METRICS)


def activity(inputs: ReportInputs, params: ReportParams, years: Iterable[int] | None = None) -> DataFrame:
    """All contributions on the fact's columns, zero-filled and dated, optionally for some event years only.

    A source none of whose years is asked for is left out of the plan, and the year ranges reach the scans.
    """
    years = None if years is None else list(years)
    rows = activity_by_file(inputs, params, years).dropna(subset=["fecha"])
    if years is not None:
        rows = rows.where(in_years(F.col("fecha"), years))
    return rows.select(*KEYS, *METRICS)


def fact_daily(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The daily fact: union of all contributions and one aggregation, hence one shuffle."""
    return daily(activity(inputs, params))


def fact_daily_fulljoin(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The same fact by null-safe full outer joins of the three daily tables."""
    visits = daily_visits(inputs.visits, params)
    surgeries = daily_surgeries(inputs.surgeries, params)
    discharges = daily_discharges(inputs.discharges, params)
    joined = null_safe_join(null_safe_join(visits, surgeries, KEYS, "full"), discharges, KEYS, "full")
    rows = zero_fill(union_by_name([fact_history(inputs, params), joined]))
    return rows.dropna(subset=["fecha"]).select(*KEYS, *METRICS)


def fact_current(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The current year's daily fact as SQL over the contributions, with year and cut-off as bound parameters.

    The contributions are a view of this one statement: they bring the date and visit rules of ``fact_daily``, and one
    scan where the records are stored together. Undated rows stay.
    """
    contributions = record_contributions(inputs, params)
    totals = ", ".join(f"CAST(sum(coalesce({m}, 0)) AS BIGINT) AS {m}" for m in METRICS)
    return contributions.sparkSession.sql(
        f"""
        SELECT clues, fecha, fecha_insert, {totals}
        FROM {{registros}}
        WHERE periodo = :anio AND fecha_insert <= :corte
        GROUP BY clues, fecha, fecha_insert
        """,
        args={"anio": params.current_year, "corte": params.cutoff},
        registros=contributions,
    )


def without_facility(rows: DataFrame) -> DataFrame:
    """Activity with facilities added up: one row per event date and registration date, NULL kept apart.

    Where rows tell the year of their file, it is a key too.
    """
    keys = [c for c in ("fecha", "fecha_insert", "periodo") if c in rows.columns]
    return rows.groupBy(*keys).agg(*sum_metrics(METRICS))


def bitemporal_summary(rows: DataFrame) -> DataFrame:
    """Activity per event date and registration date, facilities added up. Unregistered means same day."""
    registered = F.coalesce(F.col("fecha_insert"), F.col("fecha"))
    return (
        rows.withColumn("fecha_insert", registered)
        .groupBy(F.year("fecha").alias("anio"), "fecha", "fecha_insert")
        .agg(*sum_metrics(METRICS))
    )


def activity_years(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The years (anio) in which the facts have rows, from dates alone: no facility is looked up.

    A year all of whose history lies at unknown facilities is listed too.
    """
    past = inputs.history_rows.where(F.col("anio") != params.first_record_year)
    dates = past.select(as_day(past, "fecha").alias("fecha")).unionByName(record_contributions(inputs, params).select("fecha"))
    return dates.where(F.col("fecha").isNotNull()).select(F.year("fecha").alias("anio")).distinct()
