"""Oracles of weekly series, nowcast, states, rankings, KPIs, labels and charted series."""

from __future__ import annotations

from oracles.base import (
    INDICATORS,
    METRICS,
    PCT,
    PERSONS,
    SHARE,
    TARGETS,
    growth,
    light,
    percent,
    plain,
    short_scale,
    sums,
    thousands,
    with_ctes,
)
from oracles.facts import LATE_YTD

ORACLES: dict[str, str] = {}

# Series labels, report titles and card titles.
LABELS = dict(zip(METRICS, ("Totales", "Generales", "Especialidad", "Procedimientos quirúrgicos", "Egresos")))
TITLES = dict(
    zip(
        METRICS,
        (
            "Consultas totales",
            "Consultas generales",
            "Consultas de especialidad",
            "Procedimientos quirúrgicos",
            "Egresos",
        ),
    )
)
CARDS = dict(
    zip(
        METRICS + PERSONS,
        (
            "Consultas totales",
            "Consulta general",
            "Especialidad",
            "Procedimientos quirúrgicos",
            "Egresos",
            "Consultas totales",
            "Consultas generales",
            "Consultas especialidad",
            "Intervenidas",
            "Egresadas",
        ),
    )
)

# -- weekly ----------------------------------------------------------------------------------------------

WEEK = "CAST(year(fecha) AS INTEGER) AS anio, CAST(weekofyear(fecha) AS INTEGER) AS semana"
REAL = f"SELECT {WEEK}, {sums()} FROM act WHERE year(fecha) IN (1998, 1999, 2000) GROUP BY 1, 2"
MODEL = f"SELECT {WEEK}, {', '.join(f'sum({m}) AS {m}' for m in METRICS)} FROM now_day GROUP BY 1, 2"
REGISTERED = f"""SELECT {WEEK}, {sums()} FROM act
WHERE year(fecha) IN (1998, 1999, 2000) AND fecha_insert <= make_date(year(fecha), 6, 14) GROUP BY 1, 2"""


def _weeks_long(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT anio, semana, '{LABELS[m]}' AS procedimiento, CAST({m} AS DOUBLE) AS total, "
        f"CAST({TARGETS[m]} AS DOUBLE) / 52 AS meta_semanal FROM {table} WHERE semana <= 23"
        for m in METRICS
    )


SERIES = f""", r AS ({REAL}), n AS ({MODEL}),
u AS (SELECT * FROM r WHERE anio <> 2000 UNION ALL SELECT * FROM n), serie AS ({_weeks_long("u")})"""

ORACLES["weekly_real"] = with_ctes("act", REAL)
ORACLES["weekly_nowcast"] = with_ctes("now_day", MODEL)
ORACLES["weekly_registered"] = with_ctes("act", REGISTERED)
ORACLES["weekly_series"] = with_ctes("act now_day", f"{SERIES}\nSELECT * FROM serie")
ORACLES["weekly_series_registered"] = with_ctes("act", f", u AS ({REGISTERED})\n{_weeks_long('u')}")
ORACLES["custom_week"] = with_ctes(
    "act",
    f"""
SELECT CAST(year(fecha) AS INTEGER) AS anio,
       CAST(floor((dayofyear(fecha) - CASE WHEN year(fecha) = 1998 THEN 4 ELSE 1 END) / 7.0) + 1 AS INTEGER) AS semana,
       {sums()}
FROM act WHERE year(fecha) IN (1998, 1999, 2000) GROUP BY 1, 2""",
)
ORACLES["week_month_spans"] = with_ctes(
    "act",
    """
, w AS (
  SELECT anio, week, month(make_date(anio, 1, 1) + CAST((week - 1) * 7 AS INTEGER)) AS mes
  FROM (SELECT DISTINCT year(fecha) AS anio FROM act) CROSS JOIN (SELECT unnest(range(1, 53)) AS week))
SELECT CAST(anio AS INTEGER) AS anio, CAST(mes AS INTEGER) AS mes_num,
       ['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'][mes] AS mes_lab,
       CAST(min(week) AS INTEGER) AS week_ini, CAST(max(week) AS INTEGER) AS week_fin,
       (min(week) + max(week)) / CAST(2 AS DOUBLE) AS week_mid
FROM w GROUP BY anio, mes""",
)
ORACLES["last_point_per_year"] = with_ctes(
    "act now_day",
    f"""{SERIES}
SELECT procedimiento, anio, max(semana) AS semana, arg_max(total, semana) AS total
FROM serie WHERE total IS NOT NULL GROUP BY procedimiento, anio""",
)
ORACLES["label_spacing"] = with_ctes(
    "act now_day",
    f"""{SERIES},
g AS (SELECT procedimiento, 0.06::DOUBLE * coalesce(nullif(max(total) - min(total), 0), 1) AS gap
      FROM serie GROUP BY procedimiento),
p AS (SELECT procedimiento, anio, max(semana) AS semana, arg_max(total, semana) AS total
      FROM serie WHERE total IS NOT NULL GROUP BY procedimiento, anio),
o AS (SELECT p.*, gap, row_number() OVER (PARTITION BY p.procedimiento ORDER BY total, anio) AS i
      FROM p JOIN g ON p.procedimiento = g.procedimiento)
SELECT procedimiento, anio, semana, total, semana + 0.8::DOUBLE AS x_lab,
       max(total - i * gap) OVER (PARTITION BY procedimiento ORDER BY i) + i * gap AS y_lab
FROM o""",
)

# -- nowcast, targets, states ----------------------------------------------------------------------------

ORACLES["nowcast_daily"] = with_ctes("now_day", "SELECT * FROM now_day")
ORACLES["nowcast_by_state"] = with_ctes(
    "now_state",
    f"""
SELECT entidad, {", ".join(f"{m} AS {m}_observadas, {m} * 1.25::DOUBLE AS {m}_nowcast, "
                            f"{m} * 1.25::DOUBLE - {m} AS {m}_diferencias" for m in METRICS)}
FROM now_state""",
)
ORACLES["targets_by_state"] = with_ctes("goal_state", "SELECT * FROM goal_state")

STATE_YEAR = f"""
, sy AS (
  SELECT CAST(year(fecha) AS INTEGER) AS anio, goals.entidad, {", ".join(
      f"CAST(sum({m}) AS BIGINT) AS {m}" for m in METRICS[1:])}
  FROM act LEFT JOIN goals ON act.clues = goals.clues_imb
  WHERE year(fecha) IN (1998, 1999, 2000) AND year(fecha_insert) = year(fecha)
    AND fecha_insert <= make_date(year(fecha), 6, 14)
  GROUP BY 1, 2),
st AS (SELECT sy.*, g.* EXCLUDE (entidad) FROM sy LEFT JOIN goal_state AS g ON sy.entidad = g.entidad)"""
ORACLES["state_year_registered"] = with_ctes("act goal_state", f"{STATE_YEAR}\nSELECT * FROM st")
ORACLES["attainment_observed"] = with_ctes(
    "act goal_state",
    STATE_YEAR
    + " UNION ALL ".join(
        f"""
SELECT '{name}' AS indicador, entidad, CAST({metric} AS DOUBLE) AS avance_total, {goal} AS meta_total,
       CAST({metric} AS DOUBLE) / {goal} AS pct_avance_entidad
FROM st WHERE anio = 2000 AND {goal} > 0 AND entidad IS NOT NULL"""
        for name, metric, goal, _ in INDICATORS
    ),
)
CLAMPED = """
, c AS (SELECT *, greatest(0, least(pct_avance_entidad, 1)) AS pct_avance,
               greatest(0, least(pct_modelo_entidad, 1)) AS pct_modelo FROM share)"""
ORACLES["attainment_by_state"] = with_ctes(
    "share",
    f"""{CLAMPED}
SELECT indicador, entidad, avance_total, avance_modelo, meta_total, pct_avance, pct_modelo,
       greatest(pct_modelo - pct_avance, 0) AS diferencia, {light("pct_modelo", SHARE)} AS color,
       {percent("pct_modelo")} AS etiqueta_pct,
       '(' || {short_scale("avance_total")} || '/' || {short_scale("meta_total")} || ')' AS etiqueta_meta,
       row_number() OVER (PARTITION BY indicador ORDER BY round(pct_modelo, 9), entidad DESC) AS y_num
FROM c""",
)
ORACLES["traffic_light"] = with_ctes(
    "share",
    f"""{CLAMPED}
SELECT indicador, entidad, pct_modelo, {light("pct_modelo", SHARE)} AS banda,
       CASE WHEN {light("pct_modelo", SHARE)} = 'verde_fuerte' THEN 'white' ELSE 'black' END AS color_texto
FROM c""",
)
ORACLES["axis_stats"] = with_ctes(
    "share",
    f"""
, pad AS (VALUES {", ".join(f"('{n}', CAST({p} AS DOUBLE))" for n, _, _, p in INDICATORS)})
SELECT pad.col0 AS indicador, min(pct_modelo_entidad) AS minimo, max(pct_modelo_entidad) AS maximo,
       coalesce(nullif(max(pct_modelo_entidad) - min(pct_modelo_entidad), 0), 1) AS rango,
       coalesce(round_even(max(pct_modelo_entidad) + pad.col1, 1), {SHARE} + 0.10::DOUBLE) AS x_max
FROM pad LEFT JOIN share ON share.indicador = pad.col0 GROUP BY pad.col0, pad.col1""",
)
_PCTS = ", ".join(
    f"max(CASE WHEN indicador = '{n}' THEN round_even(round_even(avance_total, 0) / meta_total * 100, 0) END)"
    f" AS pct_{n}, max(CASE WHEN indicador = '{n}' THEN round_even(avance_total, 0) END) AS avance_{n}"
    for n in ("cg", "ce", "pq")
)
SCORE = f"""
, w AS (SELECT entidad, {_PCTS} FROM share WHERE indicador <> 'egresos' GROUP BY entidad),
s AS (SELECT *, round_even(({" + ".join(f"coalesce(least(pct_{n}, {PCT}), {PCT})" for n in ("cg", "ce", "pq"))}) / 3,
                           0) AS avance_global FROM w WHERE entidad <> 'Yucatan'),
score AS (
  SELECT row_number() OVER (ORDER BY avance_global DESC, entidad) AS posicion, entidad,
         coalesce({thousands("avance_cg")}, '—') AS consultas_generales, pct_cg,
         coalesce({thousands("avance_ce")}, '—') AS consultas_especialidad, pct_ce,
         coalesce({thousands("avance_pq")}, '—') AS procedimientos_quirurgicos, pct_pq,
         avance_global, {light("avance_global", PCT)} AS banda
  FROM s)"""
ORACLES["global_progress"] = with_ctes("share", f"{SCORE}\nSELECT * FROM score")
ORACLES["paged_table"] = with_ctes(
    "share",
    f"""{SCORE}
SELECT CAST(CASE WHEN posicion <= ceil(count(*) OVER () / 2.0) THEN 1 ELSE 2 END AS INTEGER) AS pagina,
       posicion, entidad, avance_global
FROM score""",
)

# -- rankings --------------------------------------------------------------------------------------------


def _ranking(category: str = "", limit: str = "") -> str:
    return f"""
, t AS (
  SELECT act.clues, CAST(sum(procedimientos_quirurgicos) AS BIGINT) AS avance FROM act
  WHERE year(fecha) = 2000 GROUP BY act.clues),
j AS (
  SELECT t.clues, t.avance, cat.nombre_comercial AS nombre_unidad, cat.entidad,
         goals.meta_cirugia_anual * {SHARE} AS debido
  FROM t LEFT JOIN cat ON t.clues = cat.clues_imb LEFT JOIN goals ON t.clues = goals.clues_imb
  WHERE goals.meta_cirugia_anual > 0 AND cat.k % 17 <> 5 {category}),
r AS (
  SELECT row_number() OVER (ORDER BY round(avance / debido, 9), clues) AS posicion, clues, nombre_unidad,
         entidad, avance, round_even(debido, 0) AS meta_acumulada,
         round_even(avance / debido * 100, 1) AS cumplimiento_pct
  FROM j {limit})"""


PAGE = "CAST(CASE WHEN posicion <= 10 THEN 1 ELSE 2 END AS INTEGER) AS pagina"
ORACLES["surgery_ranking"] = with_ctes("act cat goals", f"{_ranking()}\nSELECT * FROM r")
ORACLES["surgery_worst_ten"] = with_ctes("act cat goals", f"{_ranking()}\nSELECT * FROM r WHERE posicion <= 10")
ORACLES["surgery_zero_progress"] = with_ctes(
    "act cat goals", f"{_ranking()}\nSELECT *, {PAGE} FROM r WHERE avance = 0"
)
ORACLES["surgery_low_performers"] = with_ctes(
    "act cat goals",
    _ranking(
        "AND cat.categoria_gerencial NOT IN ('UNEME', 'Unidades moviles')",
        f"WHERE avance / debido <= {SHARE} * 0.49::DOUBLE",
    )
    + f"\nSELECT *, {PAGE} FROM r",
)

# -- KPIs ------------------------------------------------------------------------------------------------

ORACLES["kpi_wide"] = with_ctes("kpi", "SELECT * FROM kpi")


def _var(table: str, measures, year_is_text: bool) -> str:
    def pick(measure: str, year: int) -> str:
        value = f"'{year}'" if year_is_text else str(year)
        return f"CAST(max(CASE WHEN anio = {value} THEN {measure} END) AS DOUBLE)"

    return ", ".join(
        f"{growth(pick(m, 2000), pick(m, year))} AS var_2000_vs_{year}_{m}" for m in measures for year in (1999, 1998)
    )


SHARE_TO_DATE = f"""
, corte AS (
  SELECT year(fecha) AS anio, {", ".join(f"sum({m}) AS {m}" for m in METRICS)} FROM act
  WHERE year(fecha) IN (1998, 1999, 2000) AND fecha <= make_date(year(fecha), 6, 14) GROUP BY 1)"""

ORACLES["growth_wide"] = with_ctes("kpi", f"SELECT {_var('kpi', METRICS + PERSONS, True)} FROM kpi")
ORACLES["growth_ytd"] = with_ctes("act", f"{SHARE_TO_DATE}\nSELECT {_var('corte', METRICS, False)} FROM corte")


def _pairs(table: str, measures, year_is_text: bool) -> str:
    """One row per measure: current value and growth on both reference years."""
    quote = "'" if year_is_text else ""

    def pick(measure: str, year: int) -> str:
        return f"CAST(max(CASE WHEN anio = {quote}{year}{quote} THEN {measure} END) AS DOUBLE)"

    return " UNION ALL ".join(
        f"SELECT '{m}' AS indicador, CAST({i} AS BIGINT) AS orden, {pick(m, 2000)} AS valor, "
        f"{growth(pick(m, 2000), pick(m, 1999))} AS d1, {growth(pick(m, 2000), pick(m, 1998))} AS d2 FROM {table}"
        for i, m in enumerate(measures, start=1)
    )


def _delta(d: str) -> str:
    return (
        f"CASE WHEN {d} IS NULL THEN 's/d' WHEN {d} > 0 THEN '+' || {plain(d)} || '%' "
        f"WHEN {d} < 0 THEN {plain(d)} || '%' ELSE '0%' END"
    )


def _icon(d: str) -> str:
    return f"CASE WHEN {d} IS NULL THEN '' WHEN {d} > 0 THEN '▲ ' WHEN {d} < 0 THEN '▼ ' ELSE '• ' END"


def _sentence(d: str, year: int) -> str:
    return (
        f"CASE WHEN {d} IS NULL THEN 's/d que en {year}' WHEN {d} > 0 THEN {plain(d)} || '% más que {year}' "
        f"WHEN {d} < 0 THEN {plain(f'abs({d})')} || '% menos que {year}' ELSE 'igual que en {year}' END"
    )


ORACLES["kpi_cards"] = with_ctes(
    "kpi",
    f"""
, g AS ({_pairs("kpi", METRICS + PERSONS, True)})
SELECT indicador, orden,
       CASE indicador {" ".join(f"WHEN '{m}' THEN '{t}'" for m, t in CARDS.items())} END AS titulo,
       valor, coalesce({thousands("valor")}, '—') AS valor_txt,
       {_delta("d1")} AS delta_1, {_icon("d1")} AS icono_1, {_delta("d2")} AS delta_2, {_icon("d2")} AS icono_2,
       CASE WHEN d1 < 0 AND d2 < 0 THEN 'rojo' WHEN coalesce(d1 < 0, false) <> coalesce(d2 < 0, false)
            THEN 'amarillo' ELSE 'verde' END AS acento
FROM g""",
)
ORACLES["delta_text"] = with_ctes(
    "kpi act",
    f"""{SHARE_TO_DATE}, a AS ({_pairs("kpi", METRICS, True)}), b AS ({_pairs("corte", METRICS, False)}),
ab AS (SELECT *, 'proyectado' AS vista FROM a UNION ALL SELECT *, 'al_corte' FROM b)
SELECT indicador, vista, {_sentence("d1", 1999)} || chr(10) || {_sentence("d2", 1998)} AS texto FROM ab""",
)
ORACLES["progress_summary"] = with_ctes(
    "kpi act now_day",
    f"""{LATE_YTD},
v AS (
  {" UNION ALL ".join(f"SELECT 'proyectado' AS vista, '{m}' AS procedimiento, CAST(anio AS INTEGER) AS anio, "
                      f"CAST({m} AS DOUBLE) AS avance FROM kpi" for m in METRICS)}
  UNION ALL SELECT 'registrado', procedimiento, anio, valor_fecha_insert FROM late),
b AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS procedimiento, CAST(year(fecha) AS INTEGER) AS anio, "
                      f"CAST(sum({m}) AS DOUBLE) AS base FROM act WHERE year(fecha) IN (1998, 1999) GROUP BY 2"
                      for m in METRICS)}
  UNION ALL
  {" UNION ALL ".join(f"SELECT '{m}', 2000, CAST({t} AS DOUBLE)" for m, t in TARGETS.items())}),
m AS (VALUES {", ".join(f"('{m}', '{t:,}')" for m, t in TARGETS.items())})
SELECT v.vista, v.procedimiento, v.anio, avance, base, avance / nullif(base, 0) AS pct,
       coalesce({thousands("avance")}, '—') AS avance_txt,
       coalesce({percent("(avance / nullif(base, 0))")}, '') AS pct_txt, m.col1 AS meta_anual_txt,
       '44%' AS objetivo_txt
FROM v LEFT JOIN b ON v.procedimiento = b.procedimiento AND v.anio = b.anio JOIN m ON m.col0 = v.procedimiento
WHERE v.anio IN (1998, 1999, 2000)""",
)
ORACLES["indicator_growth_table"] = with_ctes(
    "ytd",
    f"""
, t AS ({" UNION ALL ".join(
    f"SELECT '{TITLES[m]}' AS indicador, coalesce(CAST(sum({m}) FILTER (anio = 1999) AS DOUBLE), 0) AS a, "
    f"coalesce(CAST(sum({m}) FILTER (anio = 2000) AS DOUBLE), 0) AS b FROM ytd" for m in METRICS)})
SELECT indicador, 'Enero-' || chr(10) || 'Junio 1999' AS periodo_anterior, a AS valor_anterior,
       'Enero-' || chr(10) || 'Junio 2000' AS periodo_actual, b AS valor_actual,
       coalesce(CASE WHEN round_even((b - a) / nullif(a, 0) * 100, 0) > 0 THEN '+' ELSE '' END
         || CAST(CAST(round_even((b - a) / nullif(a, 0) * 100, 0) AS BIGINT) AS VARCHAR) || ' %', 's/d')
         AS crecimiento_anual
FROM t""",
)
ORACLES["actual_vs_model"] = with_ctes(
    "kpi ytd",
    f"""
, parts AS ({" UNION ALL ".join(f'''
  SELECT anio, '{m}' AS procedimiento, 'Histórico' AS tipo, CAST({m} AS DOUBLE) AS valor FROM kpi WHERE anio <> '2000'
  UNION ALL SELECT '2000', '{m}', 'Observado 2000', CAST({m} AS DOUBLE) FROM ytd WHERE anio = 2000
  UNION ALL SELECT '2000', '{m}', 'Meta junio', kpi.{m} - ytd.{m} FROM kpi, ytd
            WHERE kpi.anio = '2000' AND ytd.anio = 2000''' for m in METRICS)})
SELECT *, sum(valor) OVER (PARTITION BY procedimiento, anio) AS total_anio FROM parts""",
)

# -- labels ----------------------------------------------------------------------------------------------

ORACLES["number_labels"] = with_ctes(
    "act",
    f"""
, t AS (SELECT clues, CAST(sum(consultas_totales) * 1375 AS BIGINT) AS valor FROM act GROUP BY clues),
s AS (SELECT clues, valor, CAST(valor AS DOUBLE) AS v, CAST(sum(valor) OVER () AS DOUBLE) AS todo FROM t)
SELECT clues, valor, {thousands("valor")} AS entero, {short_scale("v")} AS abreviado,
       printf('%.1f', round_even(v / CAST(100 AS DOUBLE), 0) / 10) || ' mil' AS miles,
       {percent("(v / todo)")} AS porcentaje
FROM s""",
)

_MONTHS = (
    "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre',"
    "'diciembre']"
)


def _dm(d: str) -> str:
    return f"strftime({d}, '%d') || ' de ' || {_MONTHS}[month({d})]"


ORACLES["report_labels"] = with_ctes(
    "lines",
    f"""
, h AS (SELECT DISTINCT fecha AS hoy FROM lines),
c AS (
  SELECT hoy, hoy - CAST(CASE WHEN (isodow(hoy) + 4) % 7 = 0 THEN 7 ELSE (isodow(hoy) + 4) % 7 END AS INTEGER)
           AS fecha_corte,
         hoy - CAST((isodow(hoy) + 4) % 7 AS INTEGER) AS miercoles
  FROM h),
w AS (SELECT *, fecha_corte - 6 AS inicio_semana, weekofyear(fecha_corte) - 1 AS num_semana FROM c)
SELECT hoy, fecha_corte, miercoles, inicio_semana, last_day(fecha_corte) AS fin_mes,
       {", ".join(f"CAST(fecha_corte - INTERVAL {n} YEAR AS DATE) AS fecha_corte_{n}" for n in (1, 2, 3))},
       num_semana, CAST(num_semana AS DOUBLE) / 52 AS meta_hoy, CAST(num_semana AS DOUBLE) * 100 / 52 AS pct_al_dia,
       strftime(fecha_corte, '%d_%m_%Y') AS fecha_corte_archivo, {_MONTHS}[month(fecha_corte)] AS mes_grafica_nombre,
       'Semana del ' || CASE WHEN month(inicio_semana) = month(fecha_corte) THEN strftime(inicio_semana, '%d')
                             ELSE {_dm("inicio_semana")} END
         || ' al ' || {_dm("fecha_corte")} || ' (semana ' || num_semana || ')' AS fecha_portada,
       'Al corte de ' || {_dm("fecha_corte")} || ' ' || year(fecha_corte) AS fecha_valuebox,
       'Al ' || {_dm("miercoles")} || ' ' || year(miercoles) AS fecha_txt,
       'Consultas totales del 01 de enero al ' || {_dm("miercoles")} || ' (1997-' || year(miercoles) || ')'
         AS titulo_acumulado,
       'Proyección de consultas totales para ' || {_MONTHS}[month(miercoles)] || ' ' || year(miercoles)
         || ' y tendencia ' || {_MONTHS}[month(miercoles)] || ' (1997-' || (year(miercoles) - 1) || ')' AS titulo_mes,
       '_onsultas_totales' AS slug_titulo
FROM w""",
)

# -- charted series --------------------------------------------------------------------------------------

MONTHLY = """
m AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, CAST(count(*) AS DOUBLE) AS consultas_totales
  FROM orders GROUP BY 1),
s AS (SELECT * FROM m WHERE fecha BETWEEN DATE '1996-08-01' AND DATE '2000-06-01')"""
ORACLES["period_bands"] = f"""WITH {MONTHLY},
b AS (VALUES
  (1, DATE '1996-08-01', DATE '1997-12-31', '1996 – 1997' || chr(10) || 'Años de transición', 0.92::DOUBLE),
  (2, DATE '1998-01-01', DATE '1998-12-31', '1998' || chr(10) || 'Primer año de operación', 0.91::DOUBLE),
  (3, DATE '1999-01-01', DATE '1999-12-31', '1999' || chr(10) || 'Segundo año' || chr(10) || 'de operación',
   0.94::DOUBLE),
  (4, DATE '2000-01-01', DATE '2000-06-30', '2000' || chr(10) || 'Tercer año' || chr(10) || 'de operación',
   0.86::DOUBLE))
SELECT fecha, consultas_totales, CAST(col0 AS INTEGER) AS banda, col3 AS etiqueta,
       max(consultas_totales) OVER () * col4 AS y_etiqueta, min(consultas_totales) OVER () AS minimo,
       max(consultas_totales) OVER () AS maximo
FROM s LEFT JOIN b ON fecha BETWEEN col1 AND col2"""
ORACLES["anniversary_points"] = f"""WITH {MONTHLY}
SELECT fecha, consultas_totales,
       CASE WHEN fecha = (SELECT max(fecha) FROM s) THEN 'ultimo' ELSE 'aniversario' END AS tipo,
       {thousands("consultas_totales")} || chr(10) || 'junio ' || year(fecha) AS etiqueta
FROM s WHERE month(fecha) = 6 OR fecha = (SELECT max(fecha) FROM s)"""

# -- written report: rows per section, each counted by that section's own oracle --------------------------


def report_counts(oracles: dict[str, str], sections) -> str:
    renamed = {"global_progress": "paged_table"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS seccion, count(*) AS filas FROM ({oracles[renamed.get(name, name)]}) AS q{i}"
        for i, name in enumerate(sections)
    )
