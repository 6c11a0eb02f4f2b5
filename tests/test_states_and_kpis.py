"""Attainment, rankings, KPIs, charted series and the written report on hand-made tables."""

from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.helpers import activity, day, one, rows
from tidemark import schemas
from tidemark.operators import attainment, kpi, labels, ranking, series
from tidemark.params import METRICS, PERSON_METRICS, ReportParams
from tidemark.operators.incremental import FactStore
from tidemark.plans.report import SECTIONS, Report, count_sections, write_report
from tidemark.sources.sinks import ReportSink, read_section, read_section_history, section_path, write_section
from tidemark.sources.starschema import PARAMS, StarSchemaInputs

P = ReportParams(cutoff=date(2026, 6, 10))


def shares(spark, entries):
    data = [(i, s, float(a), float(a), float(m), a / m, a / m) for i, s, a, m in entries]
    return spark.createDataFrame(
        data,
        "indicador string, entidad string, avance_total double, avance_modelo double, meta_total double, "
        "pct_avance_entidad double, pct_modelo_entidad double",
    )


@pytest.mark.parametrize(
    "value,band",
    [(0.29, "rojo"), (0.30, "amarillo"), (0.40, "verde_claro"), (0.48, "verde_fuerte"), (None, "verde_fuerte")],
)
def test_traffic_light_bands(spark, value, band):
    column = attainment.light(F.lit(value).cast("double"), 0.5, P.light_thresholds)
    assert one(spark, column) == band


def test_attainment_needs_a_target(spark):
    names = [f"{m}_{k}" for m in METRICS for k in ("observadas", "nowcast")]
    states = spark.createDataFrame(
        [("A", *[4.0, 5.0] * 5), ("B", *[4.0, 5.0] * 5), (None, *[1.0, 1.0] * 5)],
        f"entidad string, {', '.join(f'{n} double' for n in names)}",
    )
    goals = attainment.targets_by_state(
        spark.createDataFrame(
            [("1", "A", 8.0, 0.0, None, 2.0), ("2", "A", 2.0, None, 16.0, 2.0)], schemas.FACILITY_TARGETS
        )
    )
    assert rows(goals) == [("A", 10.0, 10.0, 0.0, 16.0, 4.0)]
    result = attainment.attainment(states, goals)
    assert rows(result, "indicador", "entidad", "pct_avance_entidad", "pct_modelo_entidad") == [
        ("cg", "A", 0.4, 0.5),
        ("egresos", "A", 1.0, 1.25),
        ("pq", "A", 0.25, 0.3125),
    ]
    chart = attainment.attainment_by_state(result, P)
    assert rows(chart.where("indicador = 'egresos'"), "pct_modelo", "diferencia", "etiqueta_pct", "etiqueta_meta") == [
        (1.0, 0.0, "100%", "(4.0/4.0)")
    ]


def test_display_rank_is_complete_and_ascending(spark):
    frame = shares(spark, [("cg", "A", 5, 10), ("cg", "B", 1, 10), ("cg", "C", 5, 10)])
    assert rows(attainment.attainment_by_state(frame, P), "y_num", "entidad") == [(1, "B"), (2, "C"), (3, "A")]


def test_axis_falls_back_without_shares(spark):
    stats = attainment.axis_stats(shares(spark, [("cg", "A", 44, 100)]), P)
    assert rows(stats, "indicador", "rango", "x_max")[:2] == [("ce", 1.0, P.target_share + 0.10), ("cg", 1.0, 0.5)]


def test_global_progress_caps_and_fills(spark):
    # 10 %, nothing, 50 %: the missing one counts as the cap (44.23 %), as does what lies above it.
    frame = shares(spark, [("cg", "A", 10, 100), ("pq", "A", 1500, 3000), ("cg", "Yucatan", 1, 1)])
    result = attainment.global_progress(frame, P)
    assert rows(
        result, "posicion", "entidad", "pct_cg", "consultas_especialidad", "procedimientos_quirurgicos", "avance_global"
    ) == [(1, "A", 10.0, "—", "1,500", 33.0)]


def test_half_pages(spark):
    def pages(n):
        frame = spark.createDataFrame([(i,) for i in range(1, n + 1)], "posicion long")
        return [r[0] for r in rows(ranking.half_pages(frame), "pagina")]

    assert pages(5) == [1, 1, 1, 2, 2]
    assert pages(1) == [1]
    four = spark.createDataFrame([(i,) for i in range(1, 5)], "posicion long")
    assert rows(ranking.fixed_pages(four, P), "pagina") == [(1,)] * 4
    assert rows(ranking.first_rows(four, 2)) == [(1,), (2,)]


@pytest.fixture(scope="module")
def surgery(spark):
    pq = "procedimientos_quirurgicos"
    rows_ = activity(
        spark,
        [
            ("T1", "2026-02-01", None, {pq: 10}),
            ("T2", "2026-02-01", None, {pq: 9}),
            ("Z1", "2026-02-01", None, {"consultas_totales": 4}),
            ("X1", "2026-02-01", None, {pq: 1}),
            ("N1", "2026-02-01", None, {pq: 1}),
            ("U1", "2026-02-01", None, {pq: 1}),
            ("OLD", "2025-02-01", None, {pq: 1}),
            (None, "2026-02-01", None, {pq: 1}),
        ],
    )
    facilities = spark.createDataFrame(
        [(c, None, "Jalisco", f"HG {c}", k) for c, k in
         (("T1", "Hospital"), ("T2", "Hospital"), ("Z1", "Hospital"), ("X1", "Hospital"),
          ("N1", None), ("U1", "UNEME"))],
        schemas.FACILITY_CATALOG,
    )
    goals = {"T1": 20.0, "T2": 18.0, "Z1": 30.0, "X1": 50.0, "N1": 40.0, "U1": 60.0, "OLD": 1.0, None: 80.0}
    targets = spark.createDataFrame(
        [(c, "Jalisco", None, None, g, None) for c, g in goals.items()], schemas.FACILITY_TARGETS
    )
    excluded = spark.createDataFrame([("X1",), (None,)], schemas.EXCLUDED_HOSPITALS)
    return rows_, facilities, targets, excluded


def test_surgery_ranking(spark, surgery):
    ranked = ranking.surgery_ranking(ranking.surgery_progress(*surgery, P))
    # 10/20 and 9/18 tie and go by code; a facility without code keeps its place (NULL is on no list).
    assert rows(ranked, "posicion", "clues", "avance", "meta_acumulada") == [
        (1, "Z1", 0, 13.0),
        (2, None, 1, 35.0),
        (3, "U1", 1, 27.0),
        (4, "N1", 1, 18.0),
        (5, "T1", 10, 9.0),
        (6, "T2", 9, 8.0),
    ]
    zero = ranking.surgery_zero_progress(ranked)
    assert rows(zero, "posicion", "clues", "nombre_unidad", "cumplimiento_pct") == [(1, "Z1", "HG Z1", 0.0)]


def test_low_performers_are_hospitals(spark, surgery):
    progress = ranking.surgery_progress(*surgery, P, hospitals_only=True)
    assert rows(progress, "clues") == [("T1",), ("T2",), ("Z1",)]
    assert rows(ranking.surgery_low_performers(progress, P), "posicion", "clues") == [(1, "Z1")]
    assert ranking.surgery_low_performers(progress, P, threshold=2.0).count() == 3


def test_ranking_rejects_repeated_dimension_rows(spark, surgery):
    rows_, facilities, targets, excluded = surgery
    with pytest.raises(Exception, match="targets: repeated clues"):
        ranking.surgery_progress(rows_, facilities, targets.unionByName(targets), excluded, P).collect()


def test_skewed_facility_keeps_every_row(spark, surgery):
    _, facilities, targets, excluded = surgery
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "T1").otherwise("T2").alias("clues"),
        F.lit(day("2026-03-01")).alias("fecha"),
        F.lit(None).cast("date").alias("fecha_insert"),
        *[F.lit(1).cast("bigint").alias(m) for m in METRICS],
    )
    ranked = ranking.surgery_ranking(ranking.surgery_progress(hot, facilities, targets, excluded, P))
    assert rows(ranked, "clues", "avance") == [("T1", 10_000), ("T2", 20_000)]


@pytest.fixture(scope="module")
def kpi_table(spark):
    ytd = spark.createDataFrame(
        [(2024, 50, 0, 10, 4, 1), (2025, 80, 1, 30, 4, 1), (2026, 1, 1, 1, 1, 1)],
        f"anio int, {', '.join(f'{m} long' for m in METRICS)}",
    )
    model = spark.createDataFrame(
        [(day("2026-01-01"), 60.0, 0.0, 20.0, 4.0, None), (day("2026-01-02"), 40.0, 0.0, 0.0, 0.0, None)],
        f"fecha date, {', '.join(f'{m} double' for m in METRICS)}",
    )
    persons = spark.createDataFrame(
        [(2025, 8, 8, 8, 8, 8), (2026, 10, 4, 8, 8, 8)], f"anio int, {', '.join(f'{m} long' for m in PERSON_METRICS)}"
    )
    return kpi.kpi_wide(ytd, model, persons, P)


def test_kpi_wide_takes_the_current_year_from_the_model(kpi_table):
    assert rows(kpi_table, "anio", "consultas_totales", "egresos", "personas_consulta_total") == [
        ("2024", 50.0, 1.0, None),
        ("2025", 80.0, 1.0, 8),
        ("2026", 100.0, 0.0, 10),
    ]


def test_growth_and_cards(spark, kpi_table):
    growth = kpi.growth_long(kpi_table, (*METRICS, *PERSON_METRICS), P)
    wide = kpi.growth_wide(growth, METRICS, P).first()
    assert (wide.var_2026_vs_2025_consultas_totales, wide.var_2026_vs_2024_consultas_totales) == (20.0, 50.0)
    assert wide.var_2026_vs_2025_consultas_de_especialidad == -50.0
    assert wide.var_2026_vs_2025_egresos is None  # current value 0
    cards = rows(kpi.kpi_cards(growth), "orden", "titulo", "valor_txt", "delta_1", "delta_2", "acento")
    assert cards[0] == (1, "Consultas totales", "100", "+20%", "+50%", "verde")
    assert (3, "Especialidad", "20", "-50%", "+50%", "amarillo") in cards
    assert (6, "Consultas totales", "10", "+20%", "s/d", "verde") in cards
    text = kpi.delta_text(growth, P).where("indicador = 'procedimientos_quirurgicos'").first()
    assert text.texto == "igual que en 2025\nigual que en 2024"


def test_cards_from_a_wide_row(spark):
    row = spark.createDataFrame([(7.0, -1.0, -2.0)], "a double, var_2026_vs_2025_a double, var_2026_vs_2024_a double")
    cards = kpi.kpi_cards(kpi.growth_from_wide(row, ["a"], P), {"a": "Uno"}, suffix="_m")
    assert rows(cards, "indicador", "valor_txt", "delta_1", "delta_2", "acento") == [("a_m", "7", "-1%", "-2%", "rojo")]


def test_growth_on_the_reference_year(spark):
    table = spark.createDataFrame(
        [("m", 2025, 80.0), ("m", 2026, 100.0), ("n", 2025, 0.0), ("n", 2026, 1.0)],
        "procedimiento string, anio int, total double",
    )
    assert rows(kpi.growth_ref_base(table, "total", P), "procedimiento", "crecimiento") == [("m", 25.0), ("n", None)]


def test_progress_summary(spark):
    values = spark.createDataFrame(
        [(2024, "egresos", 45.0, 100.0), (2025, "egresos", None, 200.0), (2026, "egresos", 40000.0, 1.6e6)],
        "anio int, procedimiento string, avance double, base double",
    )
    assert rows(kpi.progress_summary(values, P), "anio", "base", "avance_txt", "pct_txt", "meta_anual_txt") == [
        (2024, 100.0, "45", "45%", "1,600,000"),
        (2025, 200.0, "—", "", "1,600,000"),
        (2026, 1_600_000.0, "40,000", "2%", "1,600,000"),
    ]


def test_progress_rows_of_years_without_activity(spark):
    yearly = spark.createDataFrame(
        [("ocurrido", 2024, *[5] * 5), ("archivo", 2024, *[9] * 5), ("registrado", 2026, *[4] * 5)],
        f"vista string, grupo int, {', '.join(f'{m} long' for m in METRICS)}",
    )
    nowcast = spark.createDataFrame([(day("2026-01-02"), *[7.0] * 5)], f"fecha date, {', '.join(f'{m} double' for m in METRICS)}")
    found = kpi.progress_rows(yearly, nowcast, P).where("procedimiento = 'egresos'")
    assert rows(found, "vista", "anio", "avance", "base") == [
        ("proyectado", 2024, 5.0, 9.0),
        ("proyectado", 2026, 7.0, 1.6e6),
        ("registrado", 2024, 0.0, 9.0),
        ("registrado", 2025, 0.0, None),
        ("registrado", 2026, 4.0, 1.6e6),
    ]


def test_indicator_growth_table(spark):
    table = spark.createDataFrame(
        [("Ene-Jun 2025", 10, 0), ("Ene-Jun 2026", 8, 3), ("2026 bis", 4, 3), ("total", 99, 99)],
        "anio string, a int, b int",
    )
    result = kpi.indicator_growth_table(table, {"a": "Altas", "b": "Bajas"}, "JUNIO", P)
    assert rows(result) == [
        ("Altas", "Enero-\nJunio 2025", 10.0, "Enero-\nJunio 2026", 12.0, "+20 %"),
        ("Bajas", "Enero-\nJunio 2025", 0.0, "Enero-\nJunio 2026", 6.0, "s/d"),
    ]


def test_actual_vs_model(spark):
    observed = spark.createDataFrame([(2025, 7), (2026, 6)], "anio int, egresos long")
    model = spark.createDataFrame([(10.0,)], "egresos double")
    result = series.actual_vs_model(observed, model, P, ["egresos"])
    assert rows(result, "anio", "tipo", "valor", "total_anio") == [
        ("2025", "Histórico", 7.0, 7.0),
        ("2026", "Meta junio", 4.0, 10.0),
        ("2026", "Observado 2026", 6.0, 10.0),
    ]


def test_monthly_series(spark):
    data = [
        ("2022-07-01", 1.0),
        ("2023-06-01", 40.0),
        ("2024-06-01", 1234.5),
        ("2025-12-01", 30.0),
        ("2026-06-01", 5.0),
    ]
    monthly = spark.createDataFrame(data, "fecha string, consultas_totales double")
    bands = series.period_bands(monthly, P)
    assert rows(bands, "fecha", "banda", "minimo", "maximo")[0] == (date(2023, 6, 1), 1, 5.0, 1234.5)
    assert [r[1] for r in rows(bands, "fecha", "banda")] == [1, 2, 3, 4]
    assert rows(series.anniversary_points(monthly, P), "fecha", "tipo", "etiqueta") == [
        (date(2023, 6, 1), "aniversario", "40\njunio 2023"),
        (date(2024, 6, 1), "aniversario", "1,234\njunio 2024"),
        (date(2026, 6, 1), "ultimo", "5\njunio 2026"),
    ]


def test_year_on_year_components(spark):
    table = spark.createDataFrame(
        [("m", 2025, 100, 90, 10), ("m", 2026, 120, 0, -5)],
        "procedimiento string, anio int, valor long, valor_fecha_insert long, diferencia long",
    )
    assert rows(
        series.yoy_lag(table, P), "anio", "superior", "componente_superior", "pct_cambio", "y_total", "y_observado"
    ) == [
        (2025, 10.0, "Registro extemporáneo", None, pytest.approx(104.2), 45.0),
        (2026, 0.0, "Proyección 2026", 20.0, pytest.approx(124.2), None),
    ]


def test_report_labels(spark):
    frame = spark.createDataFrame([(day("2026-12-02"),), (day("2026-06-09"),)], "hoy date")
    by_day = {r.hoy: r for r in labels.report_labels(frame).collect()}
    late_year, june = by_day[date(2026, 12, 2)], by_day[date(2026, 6, 9)]
    assert late_year.fecha_portada == "Semana del 19 al 25 de noviembre (semana 47)"
    assert late_year.fecha_txt == "Al 02 de diciembre 2026"
    assert june.fecha_corte == date(2026, 6, 3)
    assert june.fecha_portada == "Semana del 28 de mayo al 03 de junio (semana 22)"
    assert june.titulo_acumulado == "Consultas totales del 01 de enero al 03 de junio (2023-2026)"
    assert june.titulo_mes == "Proyección de consultas totales para junio 2026 y tendencia junio (2023-2025)"
    assert june.fecha_corte_archivo == "03_06_2026"


def test_section_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x")], "a int, b string")
    write_section(frame, str(tmp_path), P.cutoff, "one")
    write_section(frame, str(tmp_path), P.cutoff, "one")
    write_section(frame.drop("b"), str(tmp_path), P.cutoff, "two")
    assert rows(read_section(spark, str(tmp_path), P.cutoff, "one"), "a", "b") == [(1, "x")]
    write_section(frame, str(tmp_path), date(2026, 6, 17), "one")
    history = read_section_history(spark, str(tmp_path), "one")
    assert rows(history, "report_date", "section", "a") == [
        (date(2026, 6, 10), "one", 1),
        (date(2026, 6, 17), "one", 1),
    ]
    assert section_path("/r/", P.cutoff, "one") == "/r/report_date=2026-06-10/section=one"


def test_a_run_that_fails_leaves_the_report_as_it_was(spark, tmp_path):
    root, frame = str(tmp_path), spark.createDataFrame([(1,)], "a int")
    write_section(frame, root, P.cutoff, "one")
    write_section(frame, root, P.cutoff, "two")
    sink = ReportSink(spark, root)
    before = sink.sections(P.cutoff)
    with pytest.raises(ValueError, match="half-way"):
        with sink.run(P.cutoff) as run:
            run.write(frame.withColumn("a", F.col("a") + 1), "one")
            frame.write.parquet(f"{run.tables}/fact")
            raise ValueError("half-way")
    assert sink.sections(P.cutoff) == before and sink.clean() == []
    # A run that is killed can't clean up; what it has written isn't seen, and goes with the next cleaning.
    killed = sink.run(P.cutoff)
    killed.write(frame.withColumn("a", F.col("a") + 2), "one")
    frame.write.parquet(f"{killed.tables}/fact")
    assert rows(read_section(spark, root, P.cutoff, "one")) == [(1,)]
    # Two runs at once, of one date and of two: nothing is lost.
    with sink.run(P.cutoff) as first, sink.run(P.cutoff) as second, sink.run(date(2026, 6, 17)) as other:
        first.write(frame.withColumn("a", F.col("a") + 3), "one")
        second.write(frame.withColumn("a", F.col("a") + 4), "two")
        other.write(frame, "one")
    assert rows(read_section(spark, root, P.cutoff, "one")) == [(4,)]
    assert rows(read_section(spark, root, P.cutoff, "two")) == [(5,)]
    assert rows(read_section(spark, root, date(2026, 6, 17), "one")) == [(1,)]
    assert len(sink.clean()) == 2 and sink.clean() == []
    assert not any(name.startswith("_tables") for name in os.listdir(root))
    assert sorted(sink.sections(P.cutoff)) == ["one", "two"]


@pytest.mark.parametrize("stored", [False, True])
def test_written_report_equals_direct_results(spark, tmp_path, stored):
    inputs = StarSchemaInputs(spark, "/root/testdata/sf0.001")
    picked = {n: SECTIONS[n] for n in ("late_registration_ytd", "surgery_zero_progress", "kpi_cards")}
    store = FactStore(spark, str(tmp_path / "_store")) if stored else None
    names = write_report(inputs, PARAMS, str(tmp_path), picked, store=store)
    assert sorted(os.listdir(tmp_path)) == ["_manifests", *["_store"] * stored, "report_date=2000-06-14"]
    direct = Report(inputs, PARAMS)
    for name in names:
        stored = read_section(spark, str(tmp_path), PARAMS.cutoff, name)
        computed = SECTIONS[name](direct)
        assert rows(stored, *computed.columns) == rows(computed)
    assert rows(count_sections(spark, str(tmp_path), PARAMS, names)) == [
        ("kpi_cards", 10),
        ("late_registration_ytd", 20),
        ("surgery_zero_progress", 1),
    ]


def test_last_date_of_a_series_is_one_row(spark):
    data = [(day("2026-06-01"), 5.0), (day("2026-06-01"), 7.0), (day("2025-06-01"), 3.0)]
    monthly = spark.createDataFrame(data, "fecha date, consultas_totales double")
    points = series.anniversary_points(monthly, P)
    assert rows(points, "fecha", "consultas_totales", "tipo") == [
        (day("2025-06-01"), 3.0, "aniversario"), (day("2026-06-01"), 7.0, "ultimo")
    ]
