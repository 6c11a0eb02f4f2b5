"""Small tables and readable results for the tests."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark import schemas
from tidemark.params import METRICS
from tidemark.sources.inputs import ReportInputs


def day(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def moment(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sorted tuples of the chosen columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def one(spark: SparkSession, column):
    """Value of a column expression over a single row."""
    return spark.range(1).select(column).first()[0]


def activity(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Activity rows from (clues, fecha, fecha_insert, metrics by name or a number for total visits)."""
    data = []
    for clues, event, registered, values in entries:
        values = values if isinstance(values, dict) else {"consultas_totales": values}
        data.append((clues, day(event), day(registered), *[values.get(m, 0) for m in METRICS]))
    return spark.createDataFrame(data, schemas.DAILY_FACT)


class TableInputs(ReportInputs):
    """Report inputs from DataFrames given by name."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)
