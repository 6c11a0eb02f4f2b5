"""Views compiled to one scan, totals by the year of the file, and the crosswalk below the join."""

from __future__ import annotations

import re
from contextlib import contextmanager
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.helpers import TableInputs, rows
from tests.test_fact import P, episodes, history, visits
from tidemark import schemas
from tidemark.operators import fact, totals
from tidemark.operators.views import View, compile_views
from tidemark.params import METRICS
from tidemark.plans.queries import QUERIES
from tidemark.plans.report import Report
from tidemark.sources.starschema import PARAMS, StarSchemaInputs

SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **conf):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table: str) -> int:
    """Scans of a file in the plan as made, subqueries included, reused exchanges not followed."""
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan_of(df)))


def test_views_with_several_groups(spark):
    frame = spark.createDataFrame(
        [(2024, 2024, 1), (2023, 2024, 2), (None, 2024, 4), (2024, 2025, 8), (2024, None, 16), (2022, None, None)],
        "e int, f int, m int",
    )
    views = [
        View("event", "e", F.col("e") >= 2023),
        View("file", "f", F.col("f").isNotNull()),
        View("none", "e", F.lit(False)),
        View("null", "e", F.lit(None).cast("boolean")),
        View("all", "f", F.lit(True)),
    ]
    found = compile_views(frame, views, {"e": F.col("e"), "f": F.col("f")}, ["m"])
    assert rows(found, "vista", "grupo", "filas", "m") == [
        ("all", None, 2, 16),
        ("all", 2024, 3, 7),
        ("all", 2025, 1, 8),
        ("event", 2023, 1, 2),
        ("event", 2024, 3, 25),
        ("file", 2024, 3, 7),
        ("file", 2025, 1, 8),
    ]
    assert rows(compile_views(frame, views[:1], {"e": F.col("e")}, ["m"]), "vista", "grupo", "m") == [
        ("event", 2023, 2), ("event", 2024, 25)
    ]
    assert compile_views(frame.limit(0), views, {"e": F.col("e"), "f": F.col("f")}, ["m"]).count() == 0


def test_views_equal_queries_of_their_own(spark):
    report = Report(StarSchemaInputs(spark, SF_DIR), PARAMS)
    past = PARAMS.recent_years
    whole = View("whole", "year", F.col("fecha").between(date(past[0], 1, 1), date(past[-1], 12, 31)))
    early = View("early", "year", F.month("fecha") <= 3)
    found = compile_views(report.activity(), [whole, early], {"year": F.year("fecha")}, METRICS)
    assert rows(found.where("vista = 'whole'"), "grupo", *METRICS) == rows(totals.year_totals(report.activity(), past))
    spring = report.activity().where(F.month("fecha") <= 3)
    assert rows(found.where("vista = 'early'"), "grupo", *METRICS) == rows(
        totals.year_totals(spring, range(1900, 2100))
    )


def test_progress_summary_scans_each_source_once(spark):
    found = QUERIES["progress_summary"](spark, SF_DIR)
    assert scans(found, "lineitem") == 1 and scans(found, "orders") == 1


@pytest.fixture(scope="module")
def mixed_files(spark):
    """A file of 2024 with an event of 2023 and undated rows; a current file with rows after the cut-off."""
    return TableInputs(
        catalog=spark.createDataFrame([("XXIMB1", "XXSSA1", "Yucatán", "HG", "Hospital")], schemas.FACILITY_CATALOG),
        history=history(spark, ["XXIMB1"]),
        visits=visits(
            spark,
            [
                ("XXIMB1", "2024-02-01", "2024-02-02", "General", 2024),
                ("XXIMB1", "2023-12-31", "2024-01-02", "generales", 2024),
                ("XXIMB1", None, "2024-01-02", "otra", 2024),
                ("XXIMB1", None, None, "especialidad", 2025),
                ("XXIMB1", "2026-02-01", "2026-02-02", "general", 2026),
                ("XXIMB1", None, "2026-02-02", "general", 2026),
                ("XXIMB1", "2026-06-01", "2026-06-11", "general", 2026),
            ],
        ),
        surgeries=episodes(spark, [("XXIMB1", None, "2024-05-05", 2024)]),
        discharges=episodes(spark, [("XXIMB1", "2025-05-05", "2025-05-05", 2024)]),
    )


def test_totals_follow_the_file_not_the_event(spark, mixed_files):
    by_file = fact.activity_by_file(mixed_files, P)
    found = totals.file_year_totals(by_file, [2024, 2025, 2026])
    assert rows(found) == [(2024, 3, 2, 0, 1, 1), (2025, 1, 0, 1, 0, 0), (2026, 2, 2, 0, 0, 0)]
    # The fact itself has neither undated rows nor the file's year, and places events by their own.
    dated = fact.activity(mixed_files, P)
    assert "periodo" not in dated.columns and dated.where("fecha IS NULL").count() == 0
    assert rows(totals.year_totals(dated, [2023, 2024, 2025]), "anio", "consultas_totales", "egresos") == [
        (2023, 2, 0), (2024, 1, 0), (2025, 0, 1)
    ]


def test_file_totals_from_the_written_fact(spark, mixed_files, tmp_path):
    from tidemark.plans.report import write_fact

    table = write_fact(mixed_files, P, str(tmp_path / "fact"))
    report = Report(mixed_files, P, table, fact.without_facility(table))
    direct = Report(mixed_files, P)
    assert rows(report.year_totals()) == rows(direct.year_totals()) == [
        (2024, 3, 2, 0, 1, 1), (2025, 1, 0, 1, 0, 0), (2026, 2, 2, 0, 0, 0)
    ]
    assert rows(report.ytd_by_year()) == rows(direct.ytd_by_year())
    for years in (None, [2023, 2024]):
        assert rows(fact.daily(report.facility_activity(years))) == rows(fact.daily(direct.facility_activity(years)))


def test_current_fact_keeps_undated_rows_and_reads_dates_leniently(spark, mixed_files):
    text = mixed_files.visits.withColumn("fecha_insert", F.col("fecha_insert").cast("string"))
    text = text.unionByName(text.where("periodo = 2026").limit(1).withColumn("fecha_insert", F.lit("no date")))
    inputs = TableInputs(**{**vars(mixed_files), "visits": text})
    found = fact.fact_current(inputs, P)
    assert rows(found, "fecha", "fecha_insert", "consultas_totales") == [
        (None, date(2026, 2, 2), 1), (date(2026, 2, 1), date(2026, 2, 2), 1)
    ]


def test_current_fact_scans_the_records_once(spark):
    assert scans(QUERIES["fact_current"](spark, SF_DIR), "lineitem") == 1


def test_crosswalk_meets_sums_of_legacy_rows_only(spark):
    inputs = StarSchemaInputs(spark, SF_DIR)
    expected = rows(fact.fact_history(inputs, PARAMS))
    looked_up = rows(totals.ytd_by_year(Report(inputs, PARAMS).activity([1997]), PARAMS))
    with settings(spark, **NO_BROADCAST):
        lazily = StarSchemaInputs(spark, SF_DIR)
        resolved = Report(lazily, PARAMS).activity([1997])
        found = totals.ytd_by_year(resolved, PARAMS)
        assert rows(found) == looked_up and rows(fact.fact_history(lazily, PARAMS)) == expected
        tree = plan_of(totals.ytd_by_year(Report(StarSchemaInputs(spark, SF_DIR), PARAMS).activity([1997]), PARAMS))
    # Every exchange that history lines reach follows a partial aggregation.
    lines = tree.split("\n")
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning(clues" in line or "Exchange hashpartitioning(cast(clues" in line:
            below = [x for x in lines[k + 1 : k + 6] if "Aggregate" in x or "SortMergeJoin" in x]
            assert below and "Aggregate" in below[0], tree


def test_hot_legacy_code_with_broadcasts_off(spark):
    catalog = spark.createDataFrame(
        [("XXIMB1", "XXSSA1", "Yucatán", "HG", None), ("XXIMB2", "XXSSA2", "Yucatán", "HG", None)], schemas.FACILITY_CATALOG
    )
    cube = history(spark, ["XXSSA1"] * 400 + ["XXIMB1"] * 30 + ["XXSSA2", "XXSSA9", None, "XXIMB7"])
    with settings(spark, **NO_BROADCAST):
        found = fact.resolve_facility_codes(cube, catalog).groupBy("clues").agg(F.sum("consultas_totales").alias("n"))
        assert rows(found) == [("XXIMB1", 430), ("XXIMB2", 1), ("XXIMB7", 1)]


# -- declared schemas, ranges, one pass ------------------------------------------------------------------


def jobs_of(spark, name, action) -> int:
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_files_start_as_many_jobs_as_few(spark, tmp_path):
    from tidemark.sources.files import drift, merging_groups, scan_union_by_name

    frame = spark.createDataFrame([("XXIMB1", date(2025, 1, 1))], "clues string, fecha_insert date")
    frame.repartition(1).write.parquet(str(tmp_path / "f0"))
    part = next((tmp_path / "f0").glob("*.parquet")).read_bytes()
    for k in range(1, 200):
        (tmp_path / f"f{k}").mkdir()
        (tmp_path / f"f{k}" / "part.parquet").write_bytes(part)
    paths = [str(tmp_path / f"f{k}") for k in range(200)]
    few = jobs_of(spark, "few", lambda: scan_union_by_name(spark, paths[:4]))
    # Listing many folders is a job of its own, whatever their number.
    assert jobs_of(spark, "many", lambda: scan_union_by_name(spark, paths)) <= few + 1
    assert scan_union_by_name(spark, paths).count() == 200
    frame.select("clues", F.lit("2025-01-02").alias("fecha_insert"), F.lit(1).alias("extra")).write.parquet(str(tmp_path / "other"))
    mixed = [*paths[:100], str(tmp_path / "other"), *paths[100:]]
    read = scan_union_by_name(spark, mixed)
    assert dict(read.dtypes)["fecha_insert"] == "string" and rows(read.groupBy("extra").count()) == [(None, 200), (1, 1)]
    found = drift(merging_groups(spark, mixed), schemas.EPISODES)
    by_column = {}
    for d in found:
        by_column.setdefault((d.column, d.declared, d.delivered), []).extend(d.paths)
    assert by_column[("extra", None, "int")] == by_column[("fecha_insert", "timestamp_ntz", "string")] == [mixed[100]]
    assert len(by_column[("fecha_egreso", "timestamp_ntz", None)]) == 201
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        merging_groups(spark, [str(tmp_path / "none"), paths[0]])


def test_records_conform_to_their_schema(spark):
    from tidemark.sources.files import conform

    delivered = spark.createDataFrame([(7, "2024-02-30", date(2024, 1, 1), "x")], "clues int, fecha_consulta string, fecha_insert date, more string")
    found = conform(delivered, schemas.VISITS)
    assert found.dtypes == [("clues", "string"), ("fecha_consulta", "string"), ("fecha_insert", "date"), ("tipo_consulta", "string")]
    assert rows(found) == [("7", "2024-02-30", date(2024, 1, 1), None)]


def test_same_day_ranges(spark):
    from tidemark.functions.dates import up_to_same_day

    days = spark.sql("SELECT explode(sequence(DATE '2022-12-25', DATE '2025-01-05')) AS d")
    for cutoff in (date(2026, 6, 10), date(2024, 2, 29), date(2023, 12, 31)):
        by_number = days.where(up_to_same_day(F.col("d"), cutoff) & F.year("d").isin(2023, 2024))
        assert rows(days.where(up_to_same_day(F.col("d"), cutoff, [2024, 2023]))) == rows(by_number)
    assert days.where(up_to_same_day(F.col("d"), date(2024, 2, 29), [2023])).count() == 0


def test_growth_table_reads_to_the_same_day(spark):
    tree = plan_of(QUERIES["indicator_growth_table"](spark, SF_DIR))
    assert re.search(r"l_shipdate#\d+ < 1999-06-15", tree) and re.search(r"l_shipdate#\d+ < 2000-06-15", tree)


@pytest.mark.parametrize("name", ["period_bands", "anniversary_points"])
def test_series_statistics_take_one_scan(spark, name):
    assert scans(QUERIES[name](spark, SF_DIR), "orders") == 1
