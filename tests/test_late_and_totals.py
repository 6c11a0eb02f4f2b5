"""Yearly totals, windows, late registration and weekly series on hand-made activity."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import activity, day, rows
from tidemark import schemas
from tidemark.operators import late, nowcast, totals, weekly
from tidemark.operators.totals import DayWindow
from tidemark.params import METRICS, ReportParams

P = ReportParams(cutoff=date(2026, 6, 10))
TOTAL = "procedimiento = 'consultas_totales'"


def daily_nowcast(spark, entries):
    data = [(day(d), float(v), 0.0, 0.0, 0.0, 0.0) for d, v in entries]
    return spark.createDataFrame(data, f"fecha date, {', '.join(f'{m} double' for m in METRICS)}")


@pytest.fixture(scope="module")
def late_rows(spark):
    return activity(
        spark,
        [
            ("A", "2023-05-01", None, 7),
            ("A", "2024-05-01", "2024-05-03", 10),
            ("A", "2024-12-20", "2025-01-05", 100),  # registered in another year
            ("A", "2025-05-01", "2025-12-01", 3),  # late
            ("A", "2025-05-02", "2025-05-02", 4),
            ("A", "2026-05-02", "2026-05-09", 6),
        ],
    )


def test_late_registration_ytd(spark, late_rows):
    model = daily_nowcast(spark, [("2026-05-01", 9), ("2026-06-11", 50)])
    result = late.late_registration_ytd(late_rows, model, P)
    columns = (
        "anio", "valor_fecha_insert", "valor_total", "superior_graf", "total_graf", "tipo_superior", "x",
        "pct_incremento",
    )
    assert rows(result.where(TOTAL), *columns) == [
        (2023, 7.0, 7.0, 0.0, 7.0, None, 1, None),
        (2024, 10.0, 10.0, 0.0, 10.0, "Registro extemporáneo", 2, None),
        (2025, 4.0, 7.0, 3.0, 7.0, "Registro extemporáneo", 3, None),
        (2026, 6.0, 9.0, 3.0, 9.0, "Proyección 2026", 4, 22.0),
    ]
    assert result.count() == 20
    broken = F.abs(F.col("valor_fecha_insert") + F.col("superior_graf") - F.col("total_graf")) > 0
    assert result.where(broken).count() == 0


def test_registered_above_total_has_no_late_part(spark):
    # Registered before it happened: counted as registered by the cut-off, not as happened by then.
    frame = activity(spark, [("A", "2025-08-01", "2025-06-01", 5), ("A", "2025-02-01", "2025-02-01", 1)])
    result = late.late_registration_ytd(frame, daily_nowcast(spark, []), P)
    assert rows(result.where(TOTAL).where("anio = 2025"), "valor_total", "superior_graf", "total_graf") == [
        (1.0, 0.0, 6.0)
    ]


def test_empty_years_stay_on_the_spine(spark):
    result = late.late_registration_ytd(activity(spark, []), daily_nowcast(spark, []), P)
    assert rows(result.where(TOTAL), "anio", "total_graf", "pct_incremento") == [
        (2023, 0.0, None),
        (2024, 0.0, None),
        (2025, 0.0, None),
        (2026, 0.0, None),
    ]


def test_late_registration_month(spark):
    frame = activity(
        spark,
        [
            ("A", "2023-06-14", None, 2),
            ("A", "2023-06-20", None, 40),  # first year: after day 15
            ("A", "2024-06-30", "2024-06-30", 5),  # whole month counts as happened, not as registered
            ("A", "2025-06-01", "2025-06-09", 8),
            ("A", "2025-05-31", "2025-06-01", 90),  # another month
            ("A", "2026-06-01", "2026-06-02", 6),
        ],
    )
    model = daily_nowcast(spark, [("2026-06-02", 5), ("2026-06-30", 5), ("2026-07-01", 70)])
    result = late.late_registration_month(frame, model, P).where(TOTAL)
    assert rows(result, "anio", "valor_fecha_insert", "valor_total", "total_graf", "pct_incremento") == [
        (2023, 2.0, 2.0, 2.0, None),
        (2024, 0.0, 5.0, 5.0, None),
        (2025, 8.0, 8.0, 8.0, None),
        (2026, 6.0, 10.0, 10.0, 25.0),
    ]


def test_leap_cutoff_drops_common_years(spark):
    frame = activity(spark, [("A", "2023-01-05", None, 1), ("A", "2024-02-29", None, 2), ("A", "2024-03-01", None, 4)])
    leap = ReportParams(cutoff=date(2024, 2, 29), years=(2021, 2022, 2023, 2024))
    assert rows(totals.ytd_by_year(frame, leap), "anio", "consultas_totales") == [(2024, 2)]
    assert rows(totals.ytd_share_of_year(frame, leap), "anio", "avance_consultas_totales") == [(2024, 2)]
    assert rows(totals.same_day_cutoff(frame, leap), "anio", "fecha_corte_anio") == [(2024, date(2024, 2, 29))]


def test_as_registered_excludes_next_year_registrations(spark, late_rows):
    assert rows(totals.as_registered(late_rows, P), "anio", "consultas_totales") == [
        (2023, 7),
        (2024, 10),
        (2025, 4),
        (2026, 6),
    ]


def test_share_of_year(spark, late_rows):
    shares = totals.ytd_share_of_year(late_rows, P)
    picked = rows(
        shares, "anio", "total_consultas_totales", "avance_consultas_totales", "pct_avance_consultas_totales",
        "pct_avance_egresos",
    )
    assert picked[0] == (2024, 110, 10, 10 / 110, None)


def test_year_totals_of_chosen_measures(spark, late_rows):
    table = totals.year_totals(late_rows, [2024, 2025], ["consultas_totales"])
    assert rows(table) == [(2024, 110), (2025, 7)]
    assert totals.total_of_year(table, "consultas_totales", 2025).first()[0] == 7
    assert totals.total_of_year(table, "consultas_totales", 2020).first()[0] == 0


def test_period_summary(spark):
    frame = activity(
        spark,
        [
            ("A", "2025-03-05", "2025-03-20", 1),
            ("A", "2025-03-05", "2025-04-20", 2),
            ("A", "2025-03-06", None, 4),
            ("A", "2025-04-01", "2025-04-01", 8),
            ("A", "2024-03-31", "2024-05-01", 16),
        ],
    )
    columns = ("anio", "valor", "valor_fecha_insert", "diferencia")
    result = totals.period_summary(frame, date(2026, 3, 1), date(2026, 3, 31), P.years)
    assert rows(result.where(TOTAL), *columns) == [(2024, 16, 0, 16), (2025, 7, 5, 2)]
    forced = totals.period_summary(frame, date(2026, 3, 1), date(2026, 3, 31), P.years, force_equal_years=(2024,))
    assert rows(forced.where(TOTAL), *columns)[0] == (2024, 16, 16, 0)


def test_overlapping_windows_count_a_row_in_each(spark):
    frame = activity(spark, [("A", "2025-03-05", None, 3)])
    windows = [
        DayWindow("marzo", date(2026, 3, 1), date(2026, 3, 31)),
        DayWindow("trimestre", date(2026, 1, 1), date(2026, 3, 31)),
        DayWindow("abril", date(2026, 4, 1), date(2026, 4, 30)),
    ]
    result = totals.window_summaries(frame, windows, P.years).where(TOTAL)
    assert rows(result, "periodo", "valor") == [("marzo", 3), ("trimestre", 3)]


def test_sum_periods_needs_every_period(spark):
    data = [("a", "m", 2024, 1, 1), ("b", "m", 2024, 2, 1), ("b", "m", 2025, 3, 3)]
    stacked = spark.createDataFrame(
        data, "periodo string, procedimiento string, anio int, valor long, valor_fecha_insert long"
    )
    assert rows(totals.sum_periods(stacked, 2)) == [("m", 2024, 3, 2, 1), ("m", 2025, None, None, None)]


def test_persons_pivot(spark):
    data = [
        (2025, "NACIONAL", "general", 5, 4),
        (2025, "NACIONAL", "qx", 2, 1),
        (2025, "JALISCO", "general", 9, 9),
        (None, "NACIONAL", "general", 9, 9),
    ]
    pivoted = totals.persons_pivot(spark.createDataFrame(data, schemas.PERSON_COUNTS), P)
    assert rows(pivoted, "anio_insert", "procedimientos_general", "personas_qx", "personas_egresos") == [
        (2025, 5, 1, 0)
    ]
    assert rows(totals.persons_by_year(pivoted), "anio", "personas_general") == [(2025, 4)]


def test_nowcast_missing_type_is_zero_missing_value_is_null(spark):
    data = [
        (day("2026-01-01"), "general", 1.0, 1.0),
        (day("2026-01-01"), "especialidad", 2.0, 1.0),
        (day("2026-01-02"), "general", None, 1.0),
        (day("2026-01-02"), "general", 4.0, 1.0),
        (day("2025-12-31"), "general", 9.0, 1.0),
        (day("2026-07-01"), "egresos", 3.0, 1.0),
    ]
    frame = spark.createDataFrame(data, schemas.NOWCAST_NATIONAL)
    daily = nowcast.nowcast_daily(frame, P)
    assert rows(daily) == [
        (date(2026, 1, 1), 3.0, 1.0, 2.0, 0.0, 0.0),
        (date(2026, 1, 2), None, None, 0.0, 0.0, 0.0),
        (date(2026, 7, 1), 0.0, 0.0, 0.0, 0.0, 3.0),
    ]
    assert tuple(nowcast.nowcast_total(daily).first()) == (3.0, 1.0, 2.0, 0.0, 3.0)
    by_week = nowcast.nowcast_weekly(daily)
    assert rows(by_week, "semana", "consultas_totales", "egresos") == [(1, None, 0.0), (27, 0.0, 3.0)]
    cut = ReportParams(cutoff=P.cutoff, nowcast_as_of=P.cutoff)
    assert nowcast.nowcast_daily(frame, cut).count() == 2


def test_nowcast_by_state(spark):
    data = [
        (day("2026-01-01"), "general", 5.0, 4.0, "MICHOACAN DE OCAMPO"),
        (day("2026-01-02"), "especialidad", 3.0, 2.0, "MICHOACAN DE OCAMPO"),
        (day("2026-06-11"), "general", 50.0, 40.0, "MICHOACAN DE OCAMPO"),
        (day("2026-01-01"), "general", 5.0, 4.0, "YUCATAN"),
    ]
    states = nowcast.nowcast_by_state(spark.createDataFrame(data, schemas.NOWCAST_STATE), P)
    assert rows(
        states, "entidad", "consultas_totales_observadas", "consultas_totales_nowcast", "consultas_totales_diferencias",
        "procedimientos_quirurgicos_nowcast",
    ) == [("Michoacan", 6.0, 8.0, 2.0, 0.0)]


def test_weekly_mixes_calendar_year_and_iso_week(spark):
    frame = activity(spark, [("A", "2024-12-30", "2024-12-30", 3), ("A", "2024-01-02", None, 4)])
    assert rows(weekly.weekly_real(frame, P), "anio", "semana", "consultas_totales") == [(2024, 1, 7)]
    assert rows(weekly.weekly_registered(frame, P), "anio", "semana") == []


def test_weekly_registered_uses_the_event_years_cutoff(spark):
    frame = activity(
        spark,
        [
            ("A", "2025-01-08", "2024-12-31", 1),  # registered before the event year
            ("A", "2025-01-08", "2025-06-10", 2),
            ("A", "2025-01-08", "2025-06-11", 4),
            ("A", "2025-01-08", None, 8),
        ],
    )
    assert rows(weekly.weekly_registered(frame, P), "anio", "semana", "consultas_totales") == [(2025, 2, 3)]


def test_weekly_series_replaces_the_current_year(spark):
    frame = activity(spark, [("A", "2025-01-08", None, 5), ("A", "2026-01-08", None, 6), ("A", "2025-08-08", None, 7)])
    model = nowcast.nowcast_weekly(daily_nowcast(spark, [("2026-01-08", 9)]))
    series = weekly.weekly_series(weekly.weekly_real(frame, P), model, P)
    shown = series.where("procedimiento = 'Totales'")
    assert rows(shown, "anio", "semana", "total") == [(2025, 2, 5.0), (2026, 2, 9.0)]
    assert rows(series.where("anio = 2025"), "procedimiento", "meta_semanal")[0] == ("Egresos", 1_600_000 / 52)


def test_weekly_totals_add_up_to_the_year(spark):
    rng = random.Random(3)
    start = date(2024, 1, 1)
    entries = [("A", str(start + timedelta(days=rng.randrange(731))), None, rng.randrange(9)) for _ in range(300)]
    frame = activity(spark, entries)
    by_week = weekly.weekly_real(frame, P).groupBy("anio").agg(F.sum("consultas_totales"))
    assert rows(by_week) == rows(totals.year_totals(frame, [2024, 2025]), "anio", "consultas_totales")


def test_last_points_and_week_spans(spark):
    series = spark.createDataFrame(
        [("T", 2025, 1, 3.0), ("T", 2025, 2, None), ("T", 2026, 1, 4.0)],
        "procedimiento string, anio int, semana int, total double",
    )
    assert rows(weekly.last_point_per_year(series)) == [("T", 2025, 1, 3.0), ("T", 2026, 1, 4.0)]
    spans = weekly.week_month_spans(spark.createDataFrame([(2026,)], "anio int"))
    assert rows(spans)[0] == (2026, 1, "ene", 1, 5, 3.0)
    assert spans.count() == 12


def push_apart(values, gap):
    placed = sorted(values)
    for i in range(1, len(placed)):
        placed[i] = max(placed[i], placed[i - 1] + gap)
    return placed


def test_label_spacing_equals_pushing_one_by_one(spark):
    rng = random.Random(11)
    data, expected = [], {}
    for case in range(200):
        values = [float(rng.randrange(40)) for _ in range(rng.randrange(1, 7))]
        data += [(str(case), 2020 + i, 1, v) for i, v in enumerate(values)]
        gap = 0.06 * ((max(values) - min(values)) or 1)
        expected[str(case)] = push_apart(values, gap)
    frame = spark.createDataFrame(data, "procedimiento string, anio int, semana int, total double")
    got = defaultdict(list)
    for row in weekly.label_spacing(frame, P).orderBy("procedimiento", "total", "anio").collect():
        got[row.procedimiento].append(row.y_lab)
    for case, heights in expected.items():
        assert got[case] == pytest.approx(heights)


def test_label_spacing_example(spark):
    data = [("T", 2020 + i, 1, v) for i, v in enumerate([10.0, 10.0, 11.0, 30.0])]
    frame = spark.createDataFrame(data, "procedimiento string, anio int, semana int, total double")
    wide_gap = ReportParams(cutoff=P.cutoff, label_gap=3 / 20)
    assert [r[0] for r in rows(weekly.label_spacing(frame, wide_gap), "y_lab")] == pytest.approx([10, 13, 16, 30])
