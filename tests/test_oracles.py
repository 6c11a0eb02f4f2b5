"""Every named query against its DuckDB oracle, values and types, on the smallest driver tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from oracles import ORACLES as REPORT_ORACLES
from pyspark.sql import functions as F
from tidemark.plans.queries import QUERIES as PLANS

SF_DIR = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}

# The reports' own queries; operators of other subpackages have tests of their own.
QUERIES = PLANS
ORACLES = REPORT_ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def _connect(directory):
    connection = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def duck():
    with _connect(SF_DIR) as connection:
        yield connection


def _canonical(value):
    return repr(value) if isinstance(value, float) else str(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    _compare(spark, duck, name, SF_DIR)


def _compare(spark, duck, name, directory):
    result = QUERIES[name](spark, directory)
    columns = sorted(result.columns)
    duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in duck.description}
    assert sorted(described) == columns
    assert described == {c: TYPES[t] for c, t in result.dtypes}
    order = [list(described).index(c) for c in columns]
    expected = sorted(tuple(_canonical(row[i]) for i in order) for row in duck.fetchall())
    actual = sorted(tuple(_canonical(row[c]) for c in columns) for row in result.collect())
    assert actual == expected


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Copies of the driver tables in which one facility and one customer hold a third of all rows.

    Broadcast joins are off and partitions count as skewed from a few kilobytes on.
    """
    directory = str(tmp_path_factory.mktemp("skewed"))
    changed = {
        "lineitem": "l_suppkey, CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey",
        "orders": "o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey",
    }
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    with _connect(SF_DIR) as connection:
        for name in ("lineitem", "orders", "customer", "supplier", "nation"):
            column, _, expression = changed.get(name, "").partition(", ")
            replaced = f"REPLACE ({expression})" if column else ""
            connection.execute(f"COPY (SELECT * {replaced} FROM {name}) TO '{directory}/{name}.parquet'")
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    with _connect(directory) as connection:
        yield directory, connection
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    [
        "fact_daily",
        "fact_daily_fulljoin",
        "late_registration_ytd",
        "nowcast_by_state",
        "number_labels",
        "persons_pivot",
        "state_year_registered",
        "surgery_ranking",
    ],
)
def test_matches_oracle_on_skewed_data_without_broadcasts(spark, skewed, name):
    directory, connection = skewed
    _compare(spark, connection, name, directory)


def test_entry_is_the_flagship_query(spark):
    rows = entry_module.entry(spark).collect()
    assert [r.anio for r in sorted(rows, key=lambda r: r.anio)] == [1997, 1998, 1999, 2000]


def test_only_the_cutoff_drops_records(spark, tmp_path):
    """Line items before the first and after the last report year reach the facts, or fall to the cut-off alone."""
    from datetime import datetime

    from tidemark.sources.starschema import StarSchemaInputs

    source = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    one = source.where("l_linenumber = 1").limit(1)
    moved = source
    for year in (1990, 2003):
        moved = moved.unionByName(one.withColumn("l_shipdate", F.lit(datetime(year, 3, 1)).cast(dict(source.dtypes)["l_shipdate"])))
    moved.write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("supplier", "nation", "orders", "customer"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    inputs = StarSchemaInputs(spark, str(tmp_path))
    assert inputs.history_rows.where("anio = 1990").count() == 1
    assert inputs.visits.where("year(fecha_consulta) = 2003 and periodo = 2000").count() == 1
    years = {r.anio for r in QUERIES["ytd_by_year"](spark, str(tmp_path)).collect()}
    assert 1990 in years and 2003 not in years
    assert {1990, 2003} <= {r.hoy.year for r in QUERIES["report_labels"](spark, str(tmp_path)).collect()}


def test_growth_reads_no_history_and_series_push_their_range(spark):
    def plan(name):
        return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()

    for name in ("growth_wide", "kpi_cards"):
        assert "1998-12-31" not in plan(name)  # the bound of the history scan
    for name in ("period_bands", "anniversary_points"):
        assert "GreaterThanOrEqual(o_orderdate" in plan(name)
    assert "s_suppkey" not in plan("week_month_spans")
