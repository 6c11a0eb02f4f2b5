"""KPIs: current values, growth against earlier years, cards, delta sentences, progress summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import inline_table, melt, sum_metrics
from tidemark.functions.numbers import (
    growth_on_current,
    growth_on_reference,
    percent_label,
    ratio,
    thousands,
)
from tidemark.functions.text import NO_DATA, accent, delta_icon, delta_label, delta_lines, sentence_case, year_in_text
from tidemark.operators.nowcast import nowcast_total
from tidemark.params import CARD_TITLES, METRICS, PERSON_METRICS, ReportParams


def with_modelled_year(ytd: DataFrame, nowcast: DataFrame, params: ReportParams) -> DataFrame:
    """Measures per year, the current year replaced by the nowcast's total. The year becomes text."""
    doubles = [F.col(m).cast("double").alias(m) for m in METRICS]
    past = ytd.where(F.col("anio") != params.current_year).select(F.col("anio").cast("string"), *doubles)
    modelled = nowcast_total(nowcast).select(F.lit(str(params.current_year)).alias("anio"), *METRICS)
    return past.unionByName(modelled)


def kpi_wide(ytd: DataFrame, nowcast: DataFrame, persons: DataFrame, params: ReportParams) -> DataFrame:
    """Measures per year with the current year taken from the nowcast, and person counts beside them.

    The year is text, as the person table's key is compared as text.
    """
    counts = persons.select(F.col("anio").cast("string").alias("anio"), *PERSON_METRICS)
    return with_modelled_year(ytd, nowcast, params).join(counts, "anio", "left")


def growth_column(measure: str, year: int, params: ReportParams) -> str:
    return f"var_{params.current_year}_vs_{year}_{measure}"


def growth_long(table: DataFrame, measures: Sequence[str], params: ReportParams) -> DataFrame:
    """Per measure: current value and growth against each earlier recent year, measured on the current year.

    Columns are indicador, valor and var_1, var_2, ... for the reference years, nearest first.
    """
    years = (params.current_year, *params.growth_reference_years)
    long = melt(
        table.where(F.col("anio").cast("int").isin(*years)),
        ["anio"],
        {m: {"_value": F.col(m).cast("double")} for m in measures},
        "indicador",
    )
    per_year = [F.max(F.when(F.col("anio").cast("int") == y, F.col("_value"))).alias(f"_{y}") for y in years]
    growth = [
        growth_on_current(F.col(f"_{params.current_year}"), F.col(f"_{y}")).alias(f"var_{i}")
        for i, y in enumerate(params.growth_reference_years, start=1)
    ]
    spread = long.groupBy("indicador").agg(*per_year)
    return spread.select("indicador", F.col(f"_{params.current_year}").alias("valor"), *growth)


def growth_wide(growth: DataFrame, measures: Sequence[str], params: ReportParams) -> DataFrame:
    """``growth_long`` as one row with a column per measure and reference year."""
    return growth.agg(
        *[
            F.expr(f"max(if(indicador = '{m}', var_{i}, null)) as {growth_column(m, y, params)}")
            for m in measures
            for i, y in enumerate(params.growth_reference_years, start=1)
        ]
    )


def growth_from_wide(row: DataFrame, measures: Sequence[str], params: ReportParams) -> DataFrame:
    """A row of values and growth columns as ``growth_long``."""
    years = list(enumerate(params.growth_reference_years, start=1))
    cells = {
        m: {
            "valor": F.col(m).cast("double"),
            **{f"var_{i}": F.col(growth_column(m, y, params)) for i, y in years},
        }
        for m in measures
    }
    return melt(row, [], cells, "indicador")


def to_cutoff(shares: DataFrame) -> DataFrame:
    """The totals to the cut-off's day of a share-of-year table, under the measures' own names."""
    return shares.select("anio", *[F.col(f"avance_{m}").alias(m) for m in METRICS])


def growth_ref_base(table: DataFrame, value: str, params: ReportParams) -> DataFrame:
    """Growth of a long table's current year measured on the year before."""
    reference = params.years[-2]
    by_series = table.groupBy("procedimiento").agg(
        F.max(F.when(F.col("anio") == reference, F.col(value))).alias("valor_referencia"),
        F.max(F.when(F.col("anio") == params.current_year, F.col(value))).alias("valor_actual"),
    )
    growth = growth_on_reference(F.col("valor_actual"), F.col("valor_referencia"))
    return by_series.withColumn("crecimiento", growth)


def kpi_cards(growth: DataFrame, titles: Mapping[str, str] = CARD_TITLES, suffix: str = "") -> DataFrame:
    """One card per titled measure of a growth table: number, two deltas, accent."""
    catalogue = inline_table(
        growth.sparkSession,
        ("indicador", "orden", "titulo"),
        [(m, i, title) for i, (m, title) in enumerate(titles.items(), start=1)],
    )
    first, second = F.col("var_1"), F.col("var_2")
    # The catalogue has one row per title.
    return growth.join(F.broadcast(catalogue), "indicador").select(
        F.concat(F.col("indicador"), F.lit(suffix)).alias("indicador"),
        F.col("orden").cast("bigint").alias("orden"),
        "titulo",
        "valor",
        F.coalesce(thousands(F.col("valor")), F.lit("—")).alias("valor_txt"),
        delta_label(first).alias("delta_1"),
        delta_icon(first).alias("icono_1"),
        delta_label(second).alias("delta_2"),
        delta_icon(second).alias("icono_2"),
        accent(first, second).alias("acento"),
    )


def delta_text(growth: DataFrame, params: ReportParams) -> DataFrame:
    """Two-line growth sentence per measure of a growth table."""
    near, far = params.growth_reference_years[:2]
    return growth.select("indicador", delta_lines(F.col("var_1"), near, F.col("var_2"), far).alias("texto"))


def progress_rows(yearly: DataFrame, nowcast: DataFrame, params: ReportParams) -> DataFrame:
    """vista, procedimiento, anio, avance, base of both views from one table of yearly views.

    ``yearly`` has vista (``ocurrido``, ``registrado``, ``archivo``), grupo (a year) and the measures. What occurred by
    the cut-off's day counts in past years, the nowcast's total in the current one; what was registered counts in all,
    0 where there is nothing. The base is all that a past year's files hold, and the target in the current year.
    """
    cells = {m: {"valor": F.col(m).cast("double")} for m in METRICS}
    long = melt(yearly, ["vista", F.col("grupo").alias("anio")], cells, "procedimiento")
    views = ("ocurrido", "registrado", "archivo")
    wide = long.groupBy("procedimiento", "anio").agg(
        *[F.max(F.when(F.col("vista") == view, F.col("valor"))).alias(view) for view in views]
    )
    spine = inline_table(
        yearly.sparkSession,
        ("procedimiento", "anio", "meta"),
        [(m, y, float(params.annual_targets[m])) for m in METRICS for y in params.recent_years],
    )
    modelled = melt(nowcast_total(nowcast), [], {m: {"modelado": F.col(m)} for m in METRICS}, "procedimiento")
    is_current = F.col("anio") == params.current_year
    # A row per measure and year, and a row per measure.
    rows = spine.join(F.broadcast(wide), ["procedimiento", "anio"], "left").join(F.broadcast(modelled), "procedimiento")
    projected = F.when(is_current, F.col("modelado")).otherwise(F.col("ocurrido"))
    both = F.array(
        F.struct(F.lit("proyectado").alias("vista"), projected.alias("avance")),
        F.struct(F.lit("registrado").alias("vista"), F.coalesce("registrado", F.lit(0.0)).alias("avance")),
    )
    base = F.when(is_current, F.col("meta")).otherwise(F.col("archivo"))
    opened = rows.select("procedimiento", "anio", base.alias("base"), is_current.alias("_now"), F.inline(both))
    # A past year in which nothing occurred has no projected row.
    told = opened.where(F.col("_now") | F.col("avance").isNotNull())
    return told.select("vista", "procedimiento", "anio", "avance", "base")


def progress_summary(values: DataFrame, params: ReportParams) -> DataFrame:
    """Value per measure and year with its share of the base: the year's total, or the target this year.

    ``values`` is long: procedimiento, anio, avance, base, and a view name if there are several.
    """
    extra = [c for c in values.columns if c not in ("procedimiento", "anio", "avance", "base")]
    share = ratio(F.col("avance"), F.col("base"))
    goal = F.element_at(
        F.create_map(*[x for m in METRICS for x in (F.lit(m), F.lit(float(params.annual_targets[m])))]),
        F.col("procedimiento"),
    )
    return values.select(
        *extra,
        "procedimiento",
        "anio",
        "avance",
        "base",
        share.alias("pct"),
        F.coalesce(thousands(F.col("avance")), F.lit("—")).alias("avance_txt"),
        F.coalesce(percent_label(share), F.lit("")).alias("pct_txt"),
        thousands(goal).alias("meta_anual_txt"),
        percent_label(F.lit(params.target_share)).alias("objetivo_txt"),
    )


def long_values(wide: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Yearly table to (anio, procedimiento, avance)."""
    numbered = wide.withColumn("anio", F.col("anio").cast("int"))
    return melt(numbered, ["anio"], {m: {"avance": F.col(m).cast("double")} for m in metrics}, "procedimiento")


def indicator_growth_table(
    table: DataFrame, labels: Mapping[str, str], month: str, params: ReportParams
) -> DataFrame:
    """Per indicator: value of the previous and the current year and signed growth on the previous one.

    The year is read out of text such as "enero-junio 2025"; several rows of one year add up.
    """
    current, previous = params.current_year, params.years[-2]
    year = year_in_text(F.col("anio"))
    wide = table.select((year == previous).alias("_p"), (year == current).alias("_c"), *labels).agg(
        *sum_metrics(labels, condition="_p", prefix="_p_"), *sum_metrics(labels, condition="_c", prefix="_c_")
    )
    cells = {
        label: {"valor_anterior": F.col(f"_p_{c}").cast("double"), "valor_actual": F.col(f"_c_{c}").cast("double")}
        for c, label in labels.items()
    }
    before, now = F.col("valor_anterior"), F.col("valor_actual")
    rate = F.bround(F.try_divide(now - before, before) * 100, 0)
    sign = F.when(rate > 0, F.lit("+")).otherwise(F.lit(""))
    growth = F.coalesce(F.concat(sign, rate.cast("bigint").cast("string"), F.lit(" %")), F.lit(NO_DATA))
    # Fixed value: the heading's wording.
    header = F.concat(F.lit("Enero-\n"), sentence_case(F.lit(month)))
    return melt(wide, [], cells, "indicador").select(
        "indicador",
        F.concat(header, F.lit(f" {previous}")).alias("periodo_anterior"),
        "valor_anterior",
        F.concat(header, F.lit(f" {current}")).alias("periodo_actual"),
        "valor_actual",
        growth.alias("crecimiento_anual"),
    )
