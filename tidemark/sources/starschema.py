"""Report inputs derived from an order / line-item star schema.

A line item stands for a visit at its supplier's facility, shipped on the day of the visit; its flags decide
whether it also counts as a surgery or a discharge. Orders stand for nowcast and person counts. Years 1997-2000
take the roles of the four report years.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.aggregates import sum_metrics
from tidemark.functions.dates import in_years
from tidemark.params import METRICS, PeriodBand, ReportParams
from tidemark.schemas import STAR_TABLES
from tidemark.sources.inputs import ReportInputs

#: The history ends with this year, in which the records begin; neither has another bound.
FIRST_RECORD_YEAR = 1998

PARAMS = ReportParams(
    cutoff=date(2000, 6, 14),
    years=(1997, 1998, 1999, 2000),
    history_last_year=1997,
    week_offsets={1998: 4},
    series_start=date(1996, 8, 1),
    series_end=date(2000, 6, 1),
    bands=(
        PeriodBand(date(1996, 8, 1), date(1997, 12, 31), "1996 – 1997\nAños de transición", 0.92),
        PeriodBand(date(1998, 1, 1), date(1998, 12, 31), "1998\nPrimer año de operación", 0.91),
        PeriodBand(date(1999, 1, 1), date(1999, 12, 31), "1999\nSegundo año\nde operación", 0.94),
        PeriodBand(date(2000, 1, 1), date(2000, 6, 30), "2000\nTercer año\nde operación", 0.86),
    ),
)


def facility_code(prefix: Column | str, key: Column) -> Column:
    """Prefix and key, zero-padded to five digits; longer keys keep all their digits."""
    digits = key.cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0"))
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, padded)


def _nowcast_type(priority: Column) -> Column:
    first = F.substring(priority, 1, 1)
    return (
        F.when(first == "1", "general")
        .when(first == "2", "especialidad")
        .when(first == "3", "qx")
        .when(first == "4", "egresos")
    )


class StarSchemaInputs(ReportInputs):
    def __init__(self, spark: SparkSession, directory: str):
        self._spark = spark
        self._directory = directory.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self._spark.read.schema(STAR_TABLES[name]).parquet(f"{self._directory}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem")

    @staticmethod
    def _is_surgery() -> Column:
        return (
            (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.05) & (F.col("l_suppkey") % 10 != 3)
        )

    @staticmethod
    def _is_discharge() -> Column:
        return (F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.04)

    @cached_property
    def _recent(self) -> DataFrame:
        """Line items from the first record year on; the bound on the ship date reaches the Parquet scan."""
        return self._lines.where(F.col("l_shipdate").cast("date") >= F.lit(date(FIRST_RECORD_YEAR, 1, 1)))

    @staticmethod
    def _record_columns(date_name: str) -> list[Column]:
        day = F.col("l_shipdate").cast("date")
        registered = F.when(
            F.col("l_linenumber") != 7, F.date_add(day, F.col("l_quantity").cast("int"))
        )
        return [
            facility_code("IMB", F.col("l_suppkey")).alias("clues"),
            F.col("l_shipdate").alias(date_name),
            registered.alias("fecha_insert"),
            # What happens after the current year would be in the current file, where the load cut-off decides.
            F.least(F.year(day), F.lit(PARAMS.current_year)).alias("periodo"),
        ]

    @staticmethod
    def _visit_type() -> Column:
        flag, year = F.col("l_returnflag"), F.year(F.col("l_shipdate").cast("date"))
        return (
            F.when(flag == "N", "General")
            .when(flag == "R", F.when(year >= PARAMS.current_year, "especialidad").otherwise("ESPECIALIDADES"))
            .otherwise("otra")
        )

    @cached_property
    def visits(self) -> DataFrame:
        return self._recent.select(
            *self._record_columns("fecha_consulta"), self._visit_type().alias("tipo_consulta")
        )

    @cached_property
    def surgeries(self) -> DataFrame:
        return self._recent.where(self._is_surgery()).select(*self._record_columns("fecha_egreso"))

    @cached_property
    def discharges(self) -> DataFrame:
        return self._recent.where(self._is_discharge()).select(*self._record_columns("fecha_egreso"))

    @cached_property
    def joint_records(self) -> DataFrame:
        return self._recent.select(
            *self._record_columns("fecha_consulta"),
            self._visit_type().alias("tipo_consulta"),
            self._is_surgery().alias("es_cirugia"),
            self._is_discharge().alias("es_egreso"),
        )

    @cached_property
    def visit_sources(self) -> DataFrame:
        """Past-year visits with the number (0-3) of the file each would have been delivered in."""
        past = range(FIRST_RECORD_YEAR, PARAMS.current_year)
        return self._recent.where(in_years(F.col("l_shipdate").cast("date"), past)).select(
            *self._record_columns("fecha_consulta"),
            self._visit_type().alias("tipo_consulta"),
            (F.col("l_linenumber") % 4).alias("archivo"),
        )

    @cached_property
    def history_rows(self) -> DataFrame:
        """History line by line; odd facilities carry their legacy code. One year overlaps the records.

        Reports add these up directly: for them, shuffling the lines into a cube first would be wasted.
        """
        day, key = F.col("l_shipdate").cast("date"), F.col("l_suppkey")
        prefix = F.when(key % 2 == 1, "SSA").otherwise("IMB")
        return self._lines.where(day <= F.lit(date(FIRST_RECORD_YEAR, 12, 31))).select(
            facility_code(prefix, key).alias("clues"),
            F.year(day).alias("anio"),
            day.alias("fecha"),
            F.lit(1).cast("bigint").alias("consultas_totales"),
            (F.col("l_returnflag") == "N").cast("bigint").alias("consultas_generales"),
            (F.col("l_returnflag") == "R").cast("bigint").alias("consultas_de_especialidad"),
            self._is_surgery().cast("bigint").alias("procedimientos_quirurgicos"),
            self._is_discharge().cast("bigint").alias("egresos"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """The history as it would be delivered: one row per facility and day."""
        return self.history_rows.groupBy("clues", "anio", "fecha").agg(*sum_metrics(METRICS))

    @cached_property
    def _states(self) -> DataFrame:
        # Grouping states the key's uniqueness, so that joins keep the other side's size estimate and small
        # facility tables are broadcast rather than shuffled.
        return self.table("nation").groupBy("n_nationkey").agg(F.first("n_name").alias("n_name"))

    @cached_property
    def _facilities(self) -> DataFrame:
        return self.table("supplier").join(self._states, F.col("s_nationkey") == F.col("n_nationkey"), "inner")

    @cached_property
    def catalog(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._facilities.select(
            facility_code("IMB", key).alias("clues_imb"),
            facility_code("SSA", key).alias("clues_ssa_y_sme"),
            F.col("n_name").alias("entidad"),
            F.col("s_name").alias("nombre_comercial"),
            F.when(key % 10 == 0, "UNEME").when(key % 10 != 1, "Hospital").alias("categoria_gerencial"),
        )

    @cached_property
    def targets(self) -> DataFrame:
        key = F.col("s_suppkey")
        surgery = (
            F.when(key % 7 == 0, F.lit(0.0))
            .when(key % 11 == 0, F.lit(None).cast("double"))
            .otherwise((10 + key % 90).cast("double"))
        )
        return self._facilities.select(
            facility_code("IMB", key).alias("clues_imb"),
            F.col("n_name").alias("entidad"),
            (20 + key % 30).cast("double").alias("meta_general_anual"),
            (15 + key % 20).cast("double").alias("meta_especialidad_anual"),
            surgery.alias("meta_cirugia_anual"),
            (15 + key % 25).cast("double").alias("meta_egresos_anual"),
        )

    @cached_property
    def excluded(self) -> DataFrame:
        return self.table("supplier").where(F.col("s_suppkey") % 17 == 5).select(
            facility_code("IMB", F.col("s_suppkey")).alias("clues_imb_hbc")
        )

    @cached_property
    def _typed_orders(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        return (
            self.table("orders")
            .where(day >= F.lit(PARAMS.current_year_start))
            .select("o_custkey", day.alias("dia"), _nowcast_type(F.col("o_orderpriority")).alias("tipo_consulta"))
        )

    @staticmethod
    def _nowcast_columns() -> list[Column]:
        observed = F.col("_n").cast("double")
        return [(observed * 1.25).alias("nowcast"), observed.alias("observadas")]

    @cached_property
    def nowcast_national(self) -> DataFrame:
        counts = self._typed_orders.groupBy("dia", "tipo_consulta").agg(F.count(F.lit(1)).alias("_n"))
        return counts.select("dia", "tipo_consulta", *self._nowcast_columns())

    @cached_property
    def nowcast_state(self) -> DataFrame:
        # Orders are counted per customer, day and type before they meet the customers, so one with very many
        # orders has collapsed by then. No hint: Spark broadcasts the customers while their size allows it.
        customers = self.table("customer").join(
            self._states, F.col("c_nationkey") == F.col("n_nationkey"), "inner"
        )
        counts = (
            self._typed_orders.groupBy("o_custkey", "dia", "tipo_consulta")
            .agg(F.count(F.lit(1)).alias("_orders"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"), "inner")
            .groupBy("dia", "tipo_consulta", F.col("n_name").alias("entidad"))
            .agg(F.sum("_orders").alias("_n"))
        )
        return counts.select("dia", "tipo_consulta", *self._nowcast_columns(), "entidad")

    @cached_property
    def persons(self) -> DataFrame:
        kind = F.coalesce(_nowcast_type(F.col("o_orderpriority")), F.lit("consulta total"))
        return (
            self.table("orders")
            .select(F.year("o_orderdate").alias("anio_insert"), kind.alias("tipo_procedimiento"), "o_custkey")
            .groupBy("anio_insert", "tipo_procedimiento")
            .agg(F.count(F.lit(1)).alias("procedimientos"), F.countDistinct("o_custkey").alias("personas"))
            .select("anio_insert", F.lit("NACIONAL").alias("id"), "tipo_procedimiento", "procedimientos", "personas")
        )

    @cached_property
    def monthly_series(self) -> DataFrame:
        # Whole months of the report's range: a bound on the order date reaches the scan, one on its month doesn't.
        day = F.col("o_orderdate").cast("date")
        first, last = PARAMS.series_start.replace(day=1), F.last_day(F.lit(PARAMS.series_end))
        return (
            self.table("orders")
            .where((day >= F.lit(first)) & (day <= last))
            .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("fecha"))
            .agg(F.count(F.lit(1)).cast("double").alias("consultas_totales"))
        )
