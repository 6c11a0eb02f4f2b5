"""Report inputs stored as Parquet or CSV files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tidemark import schemas
from tidemark.sources.inputs import ReportInputs


def _drifted_columns(frames: Sequence[DataFrame]) -> set[str]:
    """Columns whose type is not the same in every table that has them."""
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    return {name for name, found in kinds.items() if len(found) > 1}


def merging_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """The paths in runs whose files agree on the types of the columns they share, each with its files as one table.

    One job reads all footers where nothing drifts. Where something does, halves are tried, so a file that differs costs
    a few more jobs, not one for every file.
    """
    paths = list(paths)
    try:
        return [(paths, spark.read.option("mergeSchema", "true").parquet(*paths))]
    except (PySparkException, Py4JJavaError) as error:
        # Which error it is depends on whether a task or the driver met the files that differ.
        if len(paths) == 1 or not re.search("CANNOT_MERGE_(SCHEMAS|INCOMPATIBLE_DATA_TYPE)", str(error)):
            raise
    middle = len(paths) // 2
    return merging_groups(spark, paths[:middle]) + merging_groups(spark, paths[middle:])


def scan_union_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files whose columns differ as one table; a column a file lacks reads as NULL.

    One scan when shared columns agree on their types, otherwise a union that reconciles them.
    """
    return union_by_name([table for _, table in merging_groups(spark, paths)])


@dataclass(frozen=True)
class Drift:
    """What a run of files delivers otherwise than declared; None where the column isn't there, or isn't declared."""

    paths: tuple[str, ...]
    column: str
    declared: str | None
    delivered: str | None


#: Types in which a day may be delivered.
_DAYS = (DateType, TimestampType, TimestampNTZType, StringType)


def drift(groups: Sequence[tuple[Sequence[str], DataFrame]], declared: StructType) -> list[Drift]:
    """Columns that are missing, undeclared or of another type, by run of files."""
    wanted = {field.name: field.dataType.simpleString() for field in declared}
    found = []
    for paths, table in groups:
        there = dict(table.dtypes)
        for name in [*wanted, *(n for n in there if n not in wanted)]:
            if wanted.get(name) != there.get(name):
                found.append(Drift(tuple(paths), name, wanted.get(name), there.get(name)))
    return found


def conform(df: DataFrame, declared: StructType) -> DataFrame:
    """The declared columns in their order and types, missing ones NULL; others aren't read.

    Days stay as they were delivered, as dates, timestamps or text: they are read as days by the rules of ``as_day``, and
    a date that is cast first would no longer prune the scan.
    """
    there = {field.name: field.dataType for field in df.schema}

    def column(field: StructField) -> Column:
        if field.name not in there:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, _DAYS[:3]) and isinstance(there[field.name], _DAYS):
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*map(column, declared))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables whose columns differ. Numbers widen; any other drifting type becomes text."""
    drifted = _drifted_columns(frames)
    texts = {
        field.name
        for frame in frames
        for field in frame.schema
        if field.name in drifted and not isinstance(field.dataType, NumericType)
    }
    aligned = [
        frame.withColumns({name: frame[name].cast("string") for name in texts if name in frame.columns})
        if texts
        else frame
        for frame in frames
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), aligned)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table with a declared schema: CSV when the path says so, Parquet otherwise."""
    reader = spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.option("header", "true").csv(path)
    return reader.parquet(path)


@dataclass(frozen=True)
class ReportPaths:
    """File locations. Record files are listed by file year."""

    catalog: str
    targets: str
    history: str
    visits: Mapping[int, Sequence[str]]
    surgeries: Mapping[int, Sequence[str]]
    discharges: Mapping[int, Sequence[str]]
    persons: str
    nowcast_national: str
    nowcast_state: str
    excluded: str
    monthly_series: str | None = None


class FileInputs(ReportInputs):
    """Reads every source lazily, once per instance."""

    def __init__(self, spark: SparkSession, paths: ReportPaths):
        self._spark = spark
        self._paths = paths

    def _read(self, path: str, schema: StructType) -> DataFrame:
        return read_table(self._spark, path, schema)

    def _records(self, by_year: Mapping[int, Sequence[str]], declared: StructType) -> DataFrame:
        # Files of one year are merged by name; years are unioned so that a type may change between them.
        return union_by_name(
            [
                conform(scan_union_by_name(self._spark, list(paths)), declared).withColumn("periodo", F.lit(year))
                for year, paths in sorted(by_year.items())
            ]
        )

    def record_drift(self) -> dict[str, list[Drift]]:
        """By kind of record, what its files deliver otherwise than declared."""
        kinds = {
            "visits": (self._paths.visits, schemas.VISITS),
            "surgeries": (self._paths.surgeries, schemas.EPISODES),
            "discharges": (self._paths.discharges, schemas.EPISODES),
        }
        return {
            kind: drift(merging_groups(self._spark, [p for paths in by_year.values() for p in paths]), declared)
            for kind, (by_year, declared) in kinds.items()
        }

    @cached_property
    def catalog(self) -> DataFrame:
        return self._read(self._paths.catalog, schemas.FACILITY_CATALOG)

    @cached_property
    def targets(self) -> DataFrame:
        return self._read(self._paths.targets, schemas.FACILITY_TARGETS)

    @cached_property
    def history(self) -> DataFrame:
        return conform(self._spark.read.parquet(self._paths.history), schemas.HISTORY_CUBE)

    @cached_property
    def visits(self) -> DataFrame:
        return self._records(self._paths.visits, schemas.VISITS)

    @cached_property
    def surgeries(self) -> DataFrame:
        return self._records(self._paths.surgeries, schemas.EPISODES)

    @cached_property
    def discharges(self) -> DataFrame:
        return self._records(self._paths.discharges, schemas.EPISODES)

    @cached_property
    def persons(self) -> DataFrame:
        return self._read(self._paths.persons, schemas.PERSON_COUNTS)

    @cached_property
    def nowcast_national(self) -> DataFrame:
        return self._read(self._paths.nowcast_national, schemas.NOWCAST_NATIONAL)

    @cached_property
    def nowcast_state(self) -> DataFrame:
        return self._read(self._paths.nowcast_state, schemas.NOWCAST_STATE)

    @cached_property
    def excluded(self) -> DataFrame:
        return self._read(self._paths.excluded, schemas.EXCLUDED_HOSPITALS)

    @cached_property
    def monthly_series(self) -> DataFrame:
        if self._paths.monthly_series is None:
            raise ValueError("no monthly series configured")
        return self._read(self._paths.monthly_series, schemas.MONTHLY_SERIES)
