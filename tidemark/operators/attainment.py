"""Target attainment by state: ratios, traffic light, capped progress score, axis limits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import inline_table, melt, null_safe_join, require_unique, sum_metrics, sum_or_zero
from tidemark.functions.dates import in_years
from tidemark.functions.numbers import clamp01, floor_at_zero, is_finite, percent_label, ratio, short_scale, thousands
from tidemark.operators.fact import exclude_values
from tidemark.operators.totals import registered_in_time
from tidemark.params import METRICS, ReportParams


@dataclass(frozen=True)
class Indicator:
    """A measure with a state target; ``axis_pad`` is the room left above its largest ratio."""

    name: str
    metric: str
    target: str
    axis_pad: float


# The four indicators shown by state.
INDICATORS = (
    Indicator("cg", "consultas_generales", "meta_cg", 0.06),
    Indicator("ce", "consultas_de_especialidad", "meta_ce", 0.05),
    Indicator("pq", "procedimientos_quirurgicos", "meta_pq", 0.0638),
    Indicator("egresos", "egresos", "meta_egresos", 0.05),
)

# The traffic light, worst first.
LIGHTS = ("rojo", "amarillo", "verde_claro", "verde_fuerte")

STATE_METRICS = METRICS[1:]
MISSING = "—"


def targets_by_state(targets: DataFrame) -> DataFrame:
    """Annual targets per state; total visits are general plus specialty."""

    def total(*names: str) -> Column:
        parts = [sum_or_zero(F.col(name)).cast("double") for name in names]
        return parts[0] if len(parts) == 1 else parts[0] + parts[1]

    return targets.groupBy("entidad").agg(
        total("meta_general_anual", "meta_especialidad_anual").alias("meta_total"),
        total("meta_general_anual").alias("meta_cg"),
        total("meta_especialidad_anual").alias("meta_ce"),
        total("meta_cirugia_anual").alias("meta_pq"),
        total("meta_egresos_anual").alias("meta_egresos"),
    )


def _share(value: Column, target: Column) -> Column:
    return F.when(target > 0, ratio(value, target))


def _valid(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("entidad").isNotNull() & is_finite(F.col("pct_avance_entidad")))


def attainment(states: DataFrame, targets: DataFrame, indicators: Iterable[Indicator] = INDICATORS) -> DataFrame:
    """Observed and modelled share of the annual target, per indicator and state, where a target exists."""
    joined = null_safe_join(states, targets, ["entidad"])
    cells = {
        i.name: {
            "avance_total": F.col(f"{i.metric}_observadas"),
            "avance_modelo": F.col(f"{i.metric}_nowcast"),
            "meta_total": F.col(i.target),
        }
        for i in indicators
    }
    long = melt(joined, ["entidad"], cells, "indicador")
    goal = F.col("meta_total")
    return _valid(
        long.select(
            "*",
            _share(F.col("avance_total"), goal).alias("pct_avance_entidad"),
            _share(F.col("avance_modelo"), goal).alias("pct_modelo_entidad"),
        )
    )


def attainment_observed(states: DataFrame, indicators: Iterable[Indicator] = INDICATORS) -> DataFrame:
    """Observed share only, from state totals that already carry their targets."""
    cells = {
        i.name: {"avance_total": F.col(i.metric).cast("double"), "meta_total": F.col(i.target)} for i in indicators
    }
    long = melt(states, ["entidad"], cells, "indicador")
    share = _share(F.col("avance_total"), F.col("meta_total"))
    return _valid(long.withColumn("pct_avance_entidad", share))


def light(value: Column, expected: Column | float, thresholds: tuple[float, float, float]) -> Column:
    """Four bands by the share of the expected value reached; a missing value falls in the top band."""
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    chain = F.when(value < expected * thresholds[0], LIGHTS[0])
    for name, threshold in zip(LIGHTS[1:], thresholds[1:]):
        chain = chain.when(value < expected * threshold, name)
    return chain.otherwise(LIGHTS[-1])


def traffic_light(shares: DataFrame, params: ReportParams) -> DataFrame:
    """Band of every state's modelled share against the expected share at the report week."""
    share = clamp01(F.col("pct_modelo_entidad"))
    band = light(share, params.target_share, params.light_thresholds)
    return shares.select(
        "indicador",
        "entidad",
        share.alias("pct_modelo"),
        band.alias("banda"),
        F.when(band == LIGHTS[-1], "white").otherwise("black").alias("color_texto"),
    )


def attainment_by_state(shares: DataFrame, params: ReportParams) -> DataFrame:
    """The state chart's rows: limited shares, model gap, band, labels and display rank.

    The rank runs from the lowest modelled share up. Each window partition is one indicator's list of states.
    """
    reached, modelled = clamp01(F.col("pct_avance_entidad")), clamp01(F.col("pct_modelo_entidad"))
    upwards = Window.partitionBy("indicador").orderBy(
        F.round("pct_modelo", 9).asc_nulls_first(), F.col("entidad").desc()
    )
    rows = shares.withColumn("pct_avance", reached).withColumn("pct_modelo", modelled)
    return rows.select(
        "indicador",
        "entidad",
        "avance_total",
        "avance_modelo",
        "meta_total",
        "pct_avance",
        "pct_modelo",
        floor_at_zero(F.col("pct_modelo") - F.col("pct_avance")).alias("diferencia"),
        light(F.col("pct_modelo"), params.target_share, params.light_thresholds).alias("color"),
        percent_label(F.col("pct_modelo")).alias("etiqueta_pct"),
        F.concat(
            F.lit("("), short_scale(F.col("avance_total")), F.lit("/"), short_scale(F.col("meta_total")), F.lit(")")
        ).alias("etiqueta_meta"),
        F.row_number().over(upwards).cast("bigint").alias("y_num"),
    )


def axis_stats(shares: DataFrame, params: ReportParams, indicators: Iterable[Indicator] = INDICATORS) -> DataFrame:
    """Smallest, largest and range of each indicator's modelled share, and a safe axis limit.

    A flat or empty series gets range 1; without any share the limit falls back to the target plus 0.10.
    """
    spine = inline_table(
        shares.sparkSession, ("indicador", "_pad"), [(i.name, i.axis_pad) for i in indicators]
    )
    share = F.col("pct_modelo_entidad")
    found = shares.groupBy("indicador").agg(F.min(share).alias("minimo"), F.max(share).alias("maximo"))
    limit = F.coalesce(F.bround(F.col("maximo") + F.col("_pad"), 1), F.lit(params.target_share + 0.10))
    return spine.join(found, "indicador", "left").select(
        "indicador",
        "minimo",
        "maximo",
        F.coalesce(F.nullif(F.col("maximo") - F.col("minimo"), F.lit(0.0)), F.lit(1.0)).alias("rango"),
        limit.alias("x_max"),
    )


def state_year_registered(rows: DataFrame, targets: DataFrame, params: ReportParams) -> DataFrame:
    """As-registered totals per state and recent year, with the state's annual targets.

    Activity is reduced to one row per facility and year before it meets the target table.
    """
    recent = rows.where(in_years(F.col("fecha"), params.recent_years))
    kept = recent.where(registered_in_time(F.col("fecha"), F.col("fecha_insert"), params.cutoff))
    per_facility = kept.groupBy(F.year("fecha").alias("anio"), "clues").agg(*sum_metrics(STATE_METRICS))
    state_of = require_unique(targets.select(F.col("clues_imb").alias("clues"), "entidad"), "clues", "targets", null_safe=True)
    totals = (
        null_safe_join(per_facility, state_of, ["clues"])
        .groupBy("anio", "entidad")
        .agg(*sum_metrics(STATE_METRICS))
    )
    return null_safe_join(totals, targets_by_state(targets), ["entidad"])


def global_progress(shares: DataFrame, params: ReportParams) -> DataFrame:
    """Progress score per state: mean of three percentages, each capped at the expected percentage.

    A state without one of the indicators counts as having reached the cap there. Ranked best first; the
    ranking window holds one row per state.
    """
    scored = ("cg", "ce", "pq")
    cap = F.lit(params.percent_to_date)
    rows = shares.where(F.col("indicador").isin(*scored)).select(
        "entidad",
        "indicador",
        F.bround("avance_total", 0).alias("_avance"),
        F.when(
            F.col("meta_total") > 0,
            F.bround(ratio(F.bround("avance_total", 0), F.col("meta_total")) * 100, 0),
        )
        .otherwise(F.lit(0.0))
        .alias("_pct"),
    )
    picks = []
    for name in scored:
        is_it = F.col("indicador") == name
        picks.append(F.max(F.when(is_it, F.col("_avance"))).alias(f"avance_{name}"))
        picks.append(F.max(F.when(is_it, F.col("_pct"))).alias(f"pct_{name}"))
    states = exclude_values(rows.groupBy("entidad").agg(*picks), "entidad", params.excluded_score_states)
    capped = [F.least(F.col(f"pct_{name}"), cap) for name in scored]
    score = F.bround((capped[0] + capped[1] + capped[2]) / F.lit(3.0), 0)
    states = states.withColumn("avance_global", score)
    best_first = Window.orderBy(F.col("avance_global").desc_nulls_last(), "entidad")
    return states.select(
        F.row_number().over(best_first).cast("bigint").alias("posicion"),
        "entidad",
        F.coalesce(thousands(F.col("avance_cg")), F.lit(MISSING)).alias("consultas_generales"),
        "pct_cg",
        F.coalesce(thousands(F.col("avance_ce")), F.lit(MISSING)).alias("consultas_especialidad"),
        "pct_ce",
        F.coalesce(thousands(F.col("avance_pq")), F.lit(MISSING)).alias("procedimientos_quirurgicos"),
        "pct_pq",
        "avance_global",
        light(F.col("avance_global"), params.percent_to_date, params.light_thresholds).alias("banda"),
    )
