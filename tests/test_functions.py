"""Column functions on hand-made values."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tests.helpers import day, one, rows
from tidemark.functions import dates, numbers, text
from tidemark.functions.aggregates import (
    inline_table,
    null_safe_join,
    require_unique,
    strict_sum,
    strict_sum_if,
    sum_or_zero,
)
from tidemark.functions.ranking import Order, global_row_number
from tidemark.plans.queries import QUERIES
from tidemark.params import ReportParams


def lit_day(value):
    return F.lit(day(value))


@pytest.mark.parametrize("value,expected", [(2.5, 2.0), (3.5, 4.0), (-0.5, 0.0)])
def test_halves_round_to_even(spark, value, expected):
    assert one(spark, F.bround(F.lit(value), 0)) == expected


def test_growth_bases_differ(spark):
    assert one(spark, numbers.growth_on_current(F.lit(200), F.lit(150))) == 25.0
    assert one(spark, numbers.growth_on_reference(F.lit(200), F.lit(160))) == 25.0
    assert one(spark, numbers.growth_on_current(F.lit(0), F.lit(10))) is None
    assert one(spark, numbers.growth_on_reference(F.lit(10), F.lit(0))) is None


def test_cutoff_on_leap_day_admits_nothing_in_common_years(spark):
    leap = date(2024, 2, 29)
    assert one(spark, dates.same_day_in_year(F.lit(2023), leap)) is None
    assert one(spark, dates.same_day_in_year(F.lit(2024), leap)) == leap
    assert one(spark, dates.up_to_same_day(lit_day("2023-01-05"), leap)) is False
    assert one(spark, dates.up_to_same_day(lit_day("2024-02-29"), leap)) is True
    assert one(spark, dates.up_to_same_day(lit_day("2024-03-01"), leap)) is False


def test_up_to_same_day_agrees_with_the_built_date(spark):
    cutoff = date(2026, 6, 14)
    days = spark.sql("SELECT explode(sequence(DATE '2023-01-01', DATE '2026-12-31')) AS d")
    built = F.col("d") <= dates.same_day_in_year(F.year("d"), cutoff)
    assert days.where(dates.up_to_same_day(F.col("d"), cutoff) != built).count() == 0


def test_years_shift_clamps_leap_day(spark):
    assert one(spark, dates.years_back(lit_day("2024-02-29"), 1)) == date(2023, 2, 28)


@pytest.mark.parametrize("value,year,week", [("2024-12-30", 2024, 1), ("2023-01-01", 2023, 52)])
def test_iso_week_with_calendar_year(spark, value, year, week):
    assert one(spark, F.struct(F.year(lit_day(value)), F.weekofyear(lit_day(value)))) == (year, week)


@pytest.mark.parametrize("value,week", [("2024-01-01", 0), ("2024-01-03", 0), ("2024-01-04", 1), ("2025-01-01", 1)])
def test_custom_week(spark, value, week):
    d = lit_day(value)
    assert one(spark, dates.custom_week(d, F.year(d), {2024: 4})) == week


@pytest.mark.parametrize(
    "today,before,on_or_before",
    [("2026-12-02", "2026-11-25", "2026-12-02"), ("2026-12-01", "2026-11-25", "2026-11-25")],
)
def test_wednesday_rules(spark, today, before, on_or_before):
    assert one(spark, dates.wednesday_before(lit_day(today))) == day(before)
    assert one(spark, dates.wednesday_on_or_before(lit_day(today))) == day(on_or_before)
    assert ReportParams.for_run_date(day(today)).cutoff == day(before)


def test_year_and_month_ranges(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2022-12-30', DATE '2026-01-02')) AS d")
    by_year = days.where(dates.in_years(F.col("d"), [2023, 2025]))
    assert by_year.where(F.year("d").isin(2023, 2025)).count() == by_year.count() == 730
    assert days.where(dates.in_month(F.col("d"), [2024, 2025], 2)).count() == 57


def test_report_params_dates():
    params = ReportParams(cutoff=date(2026, 6, 10))
    assert (params.week_number, params.month, params.month_end) == (23, 6, date(2026, 6, 30))
    assert params.growth_reference_years == (2025, 2024)
    assert params.target_share == 23 / 52 and params.percent_to_date == 2300 / 52
    assert params.weekly_target("egresos") == 1_600_000 / 52


def test_strict_and_lenient_sums(spark):
    frame = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert frame.agg(strict_sum(F.col("x"))).first()[0] is None
    assert frame.agg(sum_or_zero(F.col("x"))).first()[0] == 1.0
    assert frame.where("x > 5").agg(sum_or_zero(F.col("x"))).first()[0] == 0
    typed = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "t string, x double")
    sums = typed.agg(*[strict_sum_if(F.col("t") == t, F.col("x")).alias(t) for t in "abc"]).first()
    assert tuple(sums) == (None, 2.0, 0.0)


def test_null_safe_full_join_merges_null_keys(spark):
    left = spark.createDataFrame([("A", None, 5)], "k string, d date, v long")
    right = spark.createDataFrame([("A", None, 2), (None, None, 3)], "k string, d date, w long")
    merged = null_safe_join(left, right, ["k", "d"], "full")
    assert rows(merged) == [(None, None, None, 3), ("A", None, 5, 2)]


def test_require_unique(spark):
    good = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    assert require_unique(good, "k", "dim").count() == 3
    bad = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="dim: repeated k"):
        require_unique(bad, "k", "dim").collect()
    with pytest.raises(Exception, match="dim: repeated k"):
        require_unique(good, "k", "dim", null_safe=True).collect()
    one_null = good.where("v < 3")
    assert require_unique(one_null, "k", "dim", null_safe=True).count() == 2


def test_inline_table(spark):
    assert rows(inline_table(spark, ("a", "b"), [(1, "x"), (2, "y")])) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("HG SAN-JUAN IMSS", "HG San-Juan IMSS"),
        ("hospital (norte) o'horan", "Hospital (Norte) O'horan"),
        ("ÁNGEL ÑANDÚ", "Ángel Ñandú"),
        ("hgz 12 'la raza'", "Hgz 12 'La Raza'"),
        ("IMSSX HGX", "Imssx Hgx"),
    ],
)
def test_facility_name(spark, raw, expected):
    assert one(spark, text.facility_name(F.lit(raw))) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("MICHOACAN DE OCAMPO", "Michoacan"),
        ("VERACRUZ DE IGNACIO DE LA LLAVE", "Veracruz"),
        ("HRAES", "HRAES"),
        ("SAN LUIS POTOSÍ", "San Luis Potosí"),
        (None, None),
    ],
)
def test_state_name(spark, raw, expected):
    assert one(spark, text.state_name(F.lit(raw).cast("string"))) == expected


def test_slug_lowers_last(spark):
    assert one(spark, text.slug(F.lit("Procedimientos quirúrgicos"))) == "_rocedimientos_quir_rgicos"


def test_year_in_text(spark):
    assert one(spark, text.year_in_text(F.lit("Enero-junio 2025"))) == 2025
    assert one(spark, text.year_in_text(F.lit(2026))) == 2026
    assert one(spark, text.year_in_text(F.lit("sin año"))) is None


@pytest.mark.parametrize(
    "delta,label,icon,sentence",
    [
        (12.0, "+12%", "▲ ", "12% más que 2025"),
        (-3.5, "-3.5%", "▼ ", "3.5% menos que 2025"),
        (0.0, "0%", "• ", "igual que en 2025"),
        (None, "s/d", "", "s/d que en 2025"),
    ],
)
def test_deltas(spark, delta, label, icon, sentence):
    column = F.lit(delta).cast("double")
    assert one(spark, text.delta_label(column)) == label
    assert one(spark, text.delta_icon(column)) == icon
    assert one(spark, text.delta_sentence(column, 2025)) == sentence


def test_infinite_delta_has_no_data(spark):
    assert one(spark, text.delta_sentence(F.lit(float("inf")), 2025)) == "s/d que en 2025"


@pytest.mark.parametrize(
    "first,second,expected", [(-1, -2, "rojo"), (-1, 2, "amarillo"), (3, None, "verde"), (None, -1, "amarillo")]
)
def test_accent(spark, first, second, expected):
    assert one(spark, text.accent(F.lit(first).cast("double"), F.lit(second).cast("double"))) == expected


@pytest.mark.parametrize(
    "value,short,compact",
    [
        (0, "0.0", "0.0 mil"),
        (12, "12.0", "0.0 mil"),
        (1250, "1.2K", "1.2 mil"),
        (2_350_000, "2.4M", "2350.0 mil"),
        (7_000_000_000, "7.0B", "7000000.0 mil"),
    ],
)
def test_number_labels(spark, value, short, compact):
    assert one(spark, numbers.short_scale(F.lit(value))) == short
    assert one(spark, numbers.compact_thousands(F.lit(value))) == compact


def test_thousands_truncates(spark):
    assert one(spark, numbers.thousands(F.lit(1234567.9))) == "1,234,567"
    assert one(spark, numbers.thousands(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("raw,expected", [("3.2%", "3%"), ("5,6 %", "6%"), ("12%", "12%"), ("n/a", "n/a"), (None, ""), ("-0,6", "-1%"), ("1.2.3", "1.2.3"), ("~ .4 pct", "0%")])
def test_rounded_percent_text(spark, raw, expected):
    assert one(spark, numbers.rounded_percent_text(F.lit(raw).cast("string"))) == expected


def test_clamp(spark):
    assert one(spark, numbers.clamp01(F.lit(1.7))) == 1.0
    assert one(spark, numbers.clamp01(F.lit(-0.2))) == 0.0
    assert one(spark, numbers.clamp01(F.lit(None).cast("double"))) is None


def test_global_row_number_matches_a_sort(spark):
    rng = random.Random(7)
    # A third of the rows share one value; ties go by key, NULLs go last.
    data = [(i, 0.0 if i % 3 == 0 else (None if i % 50 == 1 else rng.random())) for i in range(5000)]
    frame = spark.createDataFrame(data, "k long, v double").repartition(13)
    ranked = global_row_number(frame, [Order(F.col("v")), Order(F.col("k"))], total_col="n")
    expected = sorted(data, key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0.0, r[0]))
    got = sorted((r.posicion, r.k, r.n) for r in ranked.collect())
    assert got == [(i, k, 5000) for i, (k, _) in enumerate(expected, start=1)]


@pytest.mark.parametrize("descending", [False, True])
def test_global_row_number_with_half_of_all_rows_tied(spark, descending):
    frame = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, 0.5).when(F.col("id") % 11 != 0, F.rand(5)).alias("v"),
        F.concat(F.lit("IMB"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"),
    )
    by_key = [F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last(), F.col("k").asc()]
    expected = frame.withColumn("n", F.row_number().over(Window.orderBy(*by_key)))
    order = [Order(F.col("v"), descending), Order(F.col("k"))]
    ranked = global_row_number(frame, order, "n", buckets=32)
    assert rows(ranked) == rows(expected)
    # No bucket is much larger than its share, ties or not.
    sizes = [r["count"] for r in bucket_sizes(ranked).collect()]
    assert len(sizes) == 33 and max(sizes) < 4 * 20000 / 33


def bucket_sizes(ranked):
    """Rows per window partition, read off the plan's own inputs."""
    numbered = ranked._jdf.queryExecution().analyzed()
    while "_inside" not in [a.name() for a in _seq(numbered.output())] or numbered.nodeName() != "Window":
        numbered = numbered.children().head()
    session = ranked.sparkSession
    frame = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, numbered)
    return DataFrame(frame, session).groupBy("_bucket").count()


def _seq(items):
    return [items.apply(k) for k in range(items.length())]


def test_global_row_number_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, v double")
    assert global_row_number(empty, [Order(F.col("v")), Order(F.col("k"))]).count() == 0


def test_global_row_number_of_equal_rows(spark):
    frame = spark.range(300).select(F.lit(1).alias("k"))
    ranked = global_row_number(frame, [Order(F.col("k"))], "n")
    assert [r.n for r in ranked.orderBy("n").collect()] == list(range(1, 301))


@pytest.mark.parametrize("name", ["surgery_ranking", "surgery_worst_ten", "surgery_zero_progress", "surgery_low_performers"])
def test_rankings_start_no_job_while_they_are_built(spark, name):
    group = f"built-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        frame = QUERIES[name](spark, "/root/testdata/sf0.001")
        frame._jdf.queryExecution().executedPlan()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
        frame.collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
