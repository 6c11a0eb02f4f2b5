"""The daily fact kept from run to run, each run reading only what was registered since the last one.

Every record has the day it was registered, and current-year files only ever gain records with later days. So what a run
adds to the fact are the current records registered after the last run's cut-off, up to its own: a delta, aggregated to
the fact's grain and appended. All that doesn't change within a year, the history cube and the files of past years, is
the first load's delta. The fact is the sum of the deltas; operators add activity up at any grain, so they read them as
they lie.

A load is a folder of its own, written first and then named by a numbered log entry that is put in place whole, the one
thing that makes it count. A run that dies leaves a folder nobody names, which the next run removes. Loads carry the year whose files
they hold as current; in a new year another rule decides on visits and cut-offs, so the first run of a year starts over.
So does a run that is told to. A cut-off that has been reached already adds nothing, and any earlier cut-off of the year
can be asked for, as rows of current files stay recognisable by their file's year.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.aggregates import sum_metrics
from tidemark.operators import fact
from tidemark.params import METRICS, ReportParams
from tidemark.sources.folders import Folder
from tidemark.sources.inputs import ReportInputs

KEYS = (*fact.KEYS, "periodo")
#: Deltas that are read side by side before they are added up to one.
MOST_DELTAS = 60


@dataclass(frozen=True)
class State:
    """What the log's last entry says: the deltas that count, and up to which registration day they go."""

    version: int
    year: int
    mark: str
    deltas: tuple[str, ...]

    @property
    def upto(self) -> date:
        return date.fromisoformat(self.mark)


def _current(params: ReportParams) -> Column:
    return F.col("periodo") == params.current_year


def registered_between(rows: DataFrame, params: ReportParams, after: date, upto: date) -> DataFrame:
    """Contributions of current files registered after one day and up to another; the range reaches the scan."""
    day = F.col("fecha_insert")
    return rows.where(_current(params) & (day > F.lit(after)) & (day <= F.lit(upto)))


class FactStore:
    """The daily fact below a folder, by load."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._folder = spark, Folder(spark, path)

    # -- state ---------------------------------------------------------------------------------------

    def state(self) -> State | None:
        entries = [name for name in self._folder.names("log") if name.endswith(".json")]
        if not entries:
            return None
        told = json.loads(self._folder.read(f"log/{entries[-1]}"))
        return State(**told | {"deltas": tuple(told["deltas"])})

    def _commit(self, before: State | None, year: int, mark: date, deltas: tuple[str, ...]) -> State:
        state = State(before.version + 1 if before else 1, year, mark.isoformat(), deltas)
        if not self._folder.write_once(f"log/{state.version:08d}.json", json.dumps(asdict(state))):
            raise RuntimeError(f"another run has written version {state.version} of {self._folder.path}")
        return state

    def _write(self, rows: DataFrame) -> str:
        name = f"delta-{uuid.uuid4().hex}"
        fact_rows = rows.groupBy(*KEYS).agg(*sum_metrics(METRICS)).withColumn("anio", F.year("fecha"))
        fact_rows.hint("rebalance", "anio").write.partitionBy("anio").parquet(self._folder.child(name))
        return name

    def clean(self) -> list[str]:
        """Remove folders that no entry of the log counts any more, and all its entries but the last; returns the folders.

        Not while another run reads or writes the store.
        """
        state = self.state()
        kept = set(state.deltas) if state else set()
        gone = [n for n in self._folder.names() if n.startswith("delta-") and n not in kept]
        for name in gone:
            self._folder.remove(name)
        for name in self._folder.names("log")[: -1 if state else None]:
            self._folder.remove(f"log/{name}")
        return gone

    # -- loading -------------------------------------------------------------------------------------

    def new_rows(self, inputs: ReportInputs, params: ReportParams) -> DataFrame | None:
        """What a run has to read: everything at first, then what was registered since; None if that is nothing."""
        state = self.state()
        if state is None or state.year != params.current_year:
            return fact.activity_by_file(inputs, params)
        if params.cutoff <= state.upto:
            return None
        records = fact.record_contributions(inputs, params)
        fresh = registered_between(records, params, state.upto, params.cutoff)
        return fact.zero_fill(fresh, keep=("periodo",))

    def load(self, inputs: ReportInputs, params: ReportParams, afresh: bool = False) -> State:
        """Bring the store up to the cut-off."""
        state = None if afresh else self.state()
        if state is not None and state.year != params.current_year:
            state = None
        rows = fact.activity_by_file(inputs, params) if state is None else self.new_rows(inputs, params)
        if rows is None:
            return state
        added = self._write(rows)
        return self._commit(self.state(), params.current_year, params.cutoff, (*(state.deltas if state else ()), added))

    def compact(self) -> State | None:
        """One delta in place of all, with the same rows added up."""
        state = self.state()
        if state is None or len(state.deltas) < 2:
            return state
        return self._commit(state, state.year, state.upto, (self._write(self.rows()),))

    def kept_up(self, inputs: ReportInputs, params: ReportParams) -> State:
        """load, then compact once deltas are many."""
        state = self.load(inputs, params)
        return self.compact() if len(state.deltas) > MOST_DELTAS else state

    # -- reading -------------------------------------------------------------------------------------

    def rows(self, as_of: date | None = None) -> DataFrame:
        """The fact's rows with periodo and anio, undated ones included; a key may be in several deltas.

        ``as_of`` is an earlier cut-off of the same year: rows of current files registered later are left out.
        """
        state = self.state()
        if state is None:
            raise ValueError(f"nothing has been loaded to {self._folder.path}")
        if as_of is not None and (as_of > state.upto or as_of.year != state.year):
            raise ValueError(f"the store has {state.year} up to {state.mark}")
        kept = [
            self._spark.read.schema(", ".join(_SCHEMA)).parquet(self._folder.child(name)) for name in state.deltas
        ]
        rows = reduce(DataFrame.unionByName, kept)
        if as_of is None:
            return rows
        closed = F.col("periodo").isNull() | (F.col("periodo") != state.year)
        return rows.where(closed | (F.col("fecha_insert") <= F.lit(as_of)))

    def fact(self, as_of: date | None = None) -> DataFrame:
        """The daily fact itself: one row per facility, event day and registration day."""
        return fact.daily(self.rows(as_of).where(F.col("fecha").isNotNull()))

    def summary(self, as_of: date | None = None) -> DataFrame:
        """The bi-temporal summary over all loads."""
        return fact.bitemporal_summary(self.rows(as_of).where(F.col("fecha").isNotNull()))

    # -- checking ------------------------------------------------------------------------------------

    def drift(self, inputs: ReportInputs, params: ReportParams) -> DataFrame:
        """Registration days up to the mark whose current records no longer are what was loaded.

        fecha_insert, cargadas, en_origen: visits, surgeries and discharges together, in the store and in the files. Empty
        unless files were corrected after they were read; then ``load(afresh=True)`` starts over.
        """
        state = self.state()
        if state is None:
            raise ValueError(f"nothing has been loaded to {self._folder.path}")
        counted = F.coalesce("consultas_totales", F.lit(0)) + F.coalesce("procedimientos_quirurgicos", F.lit(0))
        counted = F.sum(counted + F.coalesce("egresos", F.lit(0)))
        of_year = F.col("periodo") == state.year
        here = self.rows().where(of_year).groupBy("fecha_insert").agg(counted.alias("cargadas"))
        records = fact.record_contributions(inputs, params).where(of_year & (F.col("fecha_insert") <= F.lit(state.upto)))
        there = records.groupBy("fecha_insert").agg(counted.alias("en_origen"))
        both = here.join(there, "fecha_insert", "full").na.fill(0)
        return both.where(F.col("cargadas") != F.col("en_origen"))


_SCHEMA = (
    "clues string",
    "fecha date",
    "fecha_insert date",
    "periodo int",
    *(f"{m} bigint" for m in METRICS),
    "anio int",
)
