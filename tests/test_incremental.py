"""The fact kept from run to run: many loads equal one, and a run reads only what is new."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import TableInputs, rows
from tests.test_fact import P, episodes, history, visits
from tidemark import schemas
from tidemark.operators import fact, incremental
from tidemark.operators.incremental import FactStore
from tidemark.params import ReportParams
from tidemark.plans.report import Report, write_fact
from tidemark.sources.folders import Folder
from tidemark.sources.sinks import ordered
from tidemark.sources.starschema import PARAMS, StarSchemaInputs

SF_DIR = "/root/testdata/sf0.001"


def at(day: date) -> ReportParams:
    return replace(PARAMS, cutoff=day)


def same(store: FactStore, inputs, params) -> None:
    """The store holds what a full build at the cut-off gives."""
    assert rows(store.fact()) == rows(fact.fact_daily(inputs, params))
    assert rows(store.summary()) == rows(fact.bitemporal_summary(fact.activity(inputs, params)))


def test_daily_loads_equal_one(spark, tmp_path):
    inputs, store = StarSchemaInputs(spark, SF_DIR), FactStore(spark, str(tmp_path))
    last = date(2000, 1, 20)
    days = [last - timedelta(days=k) for k in (9, 8, 7, 6, 4, 1, 0)]
    for k, day in enumerate(days, start=1):
        state = store.load(inputs, at(day))
        assert (state.version, state.upto, len(state.deltas)) == (k, day, k)
    same(store, inputs, at(last))
    for day in days[1:3]:  # what was known on an earlier day
        expected = fact.bitemporal_summary(fact.activity(inputs, at(day)))
        assert rows(store.summary(as_of=day)) == rows(expected)
    assert store.load(inputs, at(last)) == state and store.load(inputs, at(days[0])) == state
    compacted = store.compact()
    assert len(compacted.deltas) == 1 and compacted.upto == last
    same(store, inputs, at(last))
    assert len(store.clean()) == len(days) and store.clean() == [] and store.state() == compacted
    same(store, inputs, at(last))


def test_deltas_hold_only_new_registration_days(spark, tmp_path):
    inputs, store = StarSchemaInputs(spark, SF_DIR), FactStore(spark, str(tmp_path))
    store.load(inputs, at(date(2000, 3, 1)))
    state = store.load(inputs, at(date(2000, 3, 15)))
    added = spark.read.parquet(f"{tmp_path}/{state.deltas[-1]}")
    first, last = added.agg(F.min("fecha_insert"), F.max("fecha_insert")).first()
    assert date(2000, 3, 1) < first and last <= date(2000, 3, 15)


@pytest.fixture
def files(spark, tmp_path):
    """Record files with a date column; the current one has 400 rows of each day of a month, in order."""
    catalog = spark.createDataFrame([("XXIMB1", "XXSSA1", "Yucatán", "HG", "Hospital")], schemas.FACILITY_CATALOG)
    # Parquet filters of Spark know dates, not timestamps without a zone.
    past = visits(spark, [("XXIMB1", "2024-02-01", None, "General", 2024), ("XXIMB1", "2025-02-01", "2027-01-01", "x", 2025)])
    past = past.withColumn("fecha_insert", F.col("fecha_insert").cast("date"))
    days = spark.range(31 * 400).select(
        F.lit("XXIMB1").alias("clues"),
        F.lit(datetime(2026, 4, 1)).cast("timestamp_ntz").alias("fecha_consulta"),
        F.date_add(F.lit(date(2026, 5, 1)), (F.col("id") / 400).cast("int")).alias("fecha_insert"),
        F.lit("general").alias("tipo_consulta"),
        F.lit(2026).alias("periodo"),
    )
    path = str(tmp_path / "current")
    days.repartitionByRange(31, "fecha_insert").write.parquet(path)
    none = episodes(spark, [])
    inputs = TableInputs(
        catalog=catalog, history=history(spark, ["XXIMB1", "XXSSA1"]), surgeries=none, discharges=none,
        visits=past.unionByName(spark.read.parquet(path)),
    )
    return inputs, FactStore(spark, str(tmp_path / "store"))


def test_a_run_reads_only_new_registration_days(spark, files):
    inputs, store = files
    store.load(inputs, replace(P, cutoff=date(2026, 5, 20)))
    fresh = store.new_rows(inputs, replace(P, cutoff=date(2026, 5, 22)))
    plan = fresh._jdf.queryExecution().executedPlan()
    assert re.search(r"fecha_insert#\d+ >= 2026-05-21", plan.toString()) and "anio" not in fresh.columns
    assert len(fresh.collect()) == 800
    leaves = plan.collectLeaves()
    read = [n.metrics().apply("numOutputRows").value() for n in map(leaves.apply, range(leaves.length())) if "parquet" in n.nodeName()]
    assert read == [800]  # row groups of other days aren't opened; the history isn't in the plan


def test_past_files_history_and_new_years(spark, files):
    inputs, store = files
    first, second = replace(P, cutoff=date(2026, 5, 3)), replace(P, cutoff=date(2026, 5, 31))
    store.load(inputs, first)
    same(store, inputs, first)  # a past record registered after the cut-off, or never, counts
    store.load(inputs, second)
    same(store, inputs, second)
    assert rows(store.drift(inputs, second)) == []
    # In a new year last year's file is past: all of it counts, and the store starts over.
    later = replace(P, cutoff=date(2027, 2, 10), years=(2024, 2025, 2026, 2027))
    state = store.load(inputs, later)
    assert state.year == later.current_year == 2027 and len(state.deltas) == 1
    same(store, inputs, later)


def test_corrected_files_show_as_drift(spark, files):
    inputs, store = files
    cut = replace(P, cutoff=date(2026, 5, 3))
    store.load(inputs, cut)
    more = visits(spark, [("XXIMB1", "2026-04-02", "2026-05-02", "general", 2026), ("XXIMB1", "2026-04-02", "2026-05-09", "x", 2026)])
    more = more.withColumn("fecha_insert", F.col("fecha_insert").cast("date"))
    changed = TableInputs(**{**vars(inputs), "visits": inputs.visits.unionByName(more)})
    assert rows(store.drift(changed, cut)) == [(date(2026, 5, 2), 400, 401)]
    store.load(changed, cut, afresh=True)
    assert rows(store.drift(changed, cut)) == []
    same(store, changed, cut)


def test_a_run_that_dies_changes_nothing(spark, files, monkeypatch):
    inputs, store = files
    cut = replace(P, cutoff=date(2026, 5, 3))
    before = store.load(inputs, cut)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(FactStore, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        store.load(inputs, replace(P, cutoff=date(2026, 5, 5)))
    monkeypatch.undo()
    assert store.state() == before
    same(store, inputs, cut)
    assert len(store.clean()) == 1
    store.load(inputs, replace(P, cutoff=date(2026, 5, 5)))
    same(store, inputs, replace(P, cutoff=date(2026, 5, 5)))


def test_two_runs_cannot_commit_one_version(spark, files):
    inputs, store = files
    state = store.load(inputs, replace(P, cutoff=date(2026, 5, 3)))
    store._commit(state, state.year, state.upto, state.deltas)
    with pytest.raises(RuntimeError, match="another run"):
        store._commit(state, state.year, state.upto, state.deltas)


def test_report_from_the_store(spark, tmp_path):
    inputs, store = StarSchemaInputs(spark, SF_DIR), FactStore(spark, str(tmp_path / "store"))
    store.load(inputs, at(date(2000, 5, 1)))
    store.load(inputs, PARAMS)
    kept = store.rows()
    table = write_fact(inputs, PARAMS, str(tmp_path / "fact"))
    stored = Report(inputs, PARAMS, kept, fact.without_facility(kept))
    direct = Report(inputs, PARAMS, table, fact.without_facility(table))
    for name in ("progress_summary", "late_registration_ytd", "surgery_ranking", "year_totals"):
        assert rows(getattr(stored, name)()) == rows(getattr(direct, name)())


def test_folder(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert folder.names("none") == [] and not folder.exists("a")
    assert folder.write_once("a/one", "text é") and not folder.write_once("a/one", "other")
    assert folder.read("a/one") == "text é" and folder.names("a") == ["one"]
    folder.move("a", "b/c")
    assert folder.names("b/c") == ["one"] and not folder.exists("a")
    folder.write_once("d", "")
    with pytest.raises(OSError, match="could not move"):
        folder.move("d", "b/c")
    folder.remove("b")
    assert folder.names() == ["d"]


def test_nothing_loaded(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "none"))
    assert store.state() is None and store.clean() == []
    for ask in (store.rows, store.summary, lambda: store.drift(None, P)):
        with pytest.raises(ValueError, match="nothing has been loaded"):
            ask()
    assert incremental.MOST_DELTAS > 1


def test_a_facility_is_in_few_files_of_the_written_fact(spark, tmp_path):
    table = write_fact(StarSchemaInputs(spark, SF_DIR), PARAMS, str(tmp_path / "fact"))
    frame = ordered(table, ["clues", "fecha"], files=6)
    path = str(tmp_path / "one")
    frame.write.parquet(path)
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    spans = rows(stored.groupBy("file").agg(F.min("clues").alias("a"), F.max("clues").alias("z")), "a", "z")
    assert len(spans) == 6 and all(z <= a for (_, z), (a, _) in zip(spans, spans[1:]))
    wanted = spark.read.parquet(path).where(F.col("clues") == spans[3][0])
    plan = wanted._jdf.queryExecution().executedPlan()
    found = wanted.collect()
    (scan,) = [n for n in map(plan.collectLeaves().apply, range(plan.collectLeaves().length()))]
    total = stored.count()
    assert found and scan.metrics().apply("numOutputRows").value() <= total / 2  # other files' row groups stay shut
    assert rows(spark.read.parquet(path)) == rows(table.select(*frame.columns))
