"""Oracles of sources, dimensions, fact and yearly totals."""

from __future__ import annotations

from oracles.base import CORTE, METRICS, PERSONS, big, sums, with_ctes

ORACLES: dict[str, str] = {}

ORACLES["dim_facility"] = with_ctes("cat", "SELECT * EXCLUDE (k) FROM cat")
ORACLES["dim_targets"] = with_ctes("goals", "SELECT * FROM goals")

ORACLES["normalize_names"] = with_ctes(
    "cat",
    """
SELECT clues_imb, entidad,
       array_to_string(list_transform(string_split(lower('HG SAN-' || entidad || ' IMSS ' || nombre_comercial), ' '),
         lambda w: CASE WHEN w = 'hg' THEN 'HG' WHEN w = 'imss' THEN 'IMSS' ELSE
           array_to_string(list_transform(string_split(w, '-'),
             lambda p: upper(left(p, 1)) || substr(p, 2)), '-') END), ' ') AS nombre_unidad
FROM cat""",
)

ORACLES["exclude_list"] = with_ctes(
    "cat",
    """
SELECT * EXCLUDE (k) FROM cat
WHERE entidad NOT IN ('Nation_7', 'Nation_12')
  AND (categoria_gerencial IS NULL OR categoria_gerencial NOT IN ('UNEME', 'Unidades moviles'))
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 17 = 5 AND s_suppkey = cat.k)""",
)

ORACLES["fact_history"] = with_ctes("hist", "SELECT * FROM hist")

ORACLES["scan_union_by_name"] = with_ctes(
    "lines",
    """
SELECT clues, fecha, ins AS fecha_insert, count(*) AS consultas_totales,
       count(*) FILTER (archivo <> 0 AND flag = 'N') AS consultas_generales,
       count(*) FILTER (archivo <> 0 AND flag = 'R') AS consultas_de_especialidad
FROM lines WHERE y IN (1998, 1999) GROUP BY ALL""",
)

ORACLES["daily_visits"] = with_ctes(
    "recs",
    """
SELECT clues, fecha, ins AS fecha_insert, count(*) AS consultas_totales,
       count(*) FILTER (flag = 'N') AS consultas_generales,
       count(*) FILTER (flag = 'R') AS consultas_de_especialidad
FROM recs GROUP BY ALL""",
)
for _name, _flag, _metric in (
    ("daily_surgeries", "cir", "procedimientos_quirurgicos"),
    ("daily_discharges", "egr", "egresos"),
):
    ORACLES[_name] = with_ctes(
        "recs", f"SELECT clues, fecha, ins AS fecha_insert, count(*) AS {_metric} FROM recs WHERE {_flag} GROUP BY ALL"
    )

ORACLES["fact_current"] = with_ctes(
    "recs",
    """
SELECT clues, fecha, ins AS fecha_insert, count(*) AS consultas_totales,
       count(*) FILTER (flag = 'N') AS consultas_generales,
       count(*) FILTER (flag = 'R') AS consultas_de_especialidad,
       count(*) FILTER (cir) AS procedimientos_quirurgicos, count(*) FILTER (egr) AS egresos
FROM recs WHERE y = 2000 GROUP BY ALL""",
)

ORACLES["fact_daily"] = with_ctes(
    "act", f"SELECT clues, fecha, fecha_insert, {sums()} FROM act GROUP BY clues, fecha, fecha_insert"
)
ORACLES["fact_daily_fulljoin"] = ORACLES["fact_daily"]

ORACLES["bitemporal_summary"] = with_ctes(
    "act",
    f"""
SELECT CAST(year(fecha) AS INTEGER) AS anio, fecha, coalesce(fecha_insert, fecha) AS fecha_insert, {sums()}
FROM act GROUP BY act.fecha, coalesce(act.fecha_insert, act.fecha)""",
)

ORACLES["fact_ordered"] = with_ctes(
    "hist recs",
    f"""
, alle AS (
  SELECT clues, fecha, CAST(NULL AS DATE) AS fecha_insert, CAST(NULL AS INTEGER) AS periodo, {", ".join(METRICS)} FROM hist
  UNION ALL
  SELECT clues, fecha, ins, CAST(least(y, 2000) AS INTEGER), 1, CASE WHEN flag = 'N' THEN 1 ELSE 0 END,
         CASE WHEN flag = 'R' THEN 1 ELSE 0 END, CASE WHEN cir THEN 1 ELSE 0 END, CASE WHEN egr THEN 1 ELSE 0 END FROM recs)
SELECT clues, fecha, fecha_insert, periodo, {sums()}, CAST(year(fecha) AS INTEGER) AS anio
FROM alle GROUP BY clues, fecha, fecha_insert, periodo""",
)

# Many loads give what one build gives.
ORACLES["incremental_summary"] = ORACLES["bitemporal_summary"]

ORACLES["same_day_cutoff"] = with_ctes(
    "act",
    f"""
SELECT CAST(year(fecha) AS INTEGER) AS anio, make_date(year(fecha), 6, 14) AS fecha_corte_anio,
       max(fecha) AS ultima_fecha, {sums()}
FROM act WHERE fecha <= make_date(year(fecha), 6, 14) GROUP BY year(fecha)""",
)

ORACLES["as_registered"] = with_ctes(
    "act",
    f"""
SELECT CAST(year(fecha) AS INTEGER) AS anio, {sums()}
FROM act WHERE year(fecha) BETWEEN 1997 AND 2000 AND year(coalesce(fecha_insert, fecha)) = year(fecha)
  AND coalesce(fecha_insert, fecha) <= make_date(year(fecha), 6, 14)
GROUP BY year(fecha)""",
)

ORACLES["ytd_by_year"] = with_ctes("ytd", "SELECT * FROM ytd")

# By the year of the file: records of 2000 and later are in the file of 2000.
ORACLES["year_totals"] = with_ctes(
    "recs",
    f"""
SELECT CAST(least(y, 2000) AS INTEGER) AS anio, {", ".join(big(c, m) for m, c in zip(METRICS, (
    "count(*)", "count(*) FILTER (flag = 'N')", "count(*) FILTER (flag = 'R')", "count(*) FILTER (cir)",
    "count(*) FILTER (egr)")))}
FROM recs WHERE y >= 1998 GROUP BY 1""",
)

ORACLES["ytd_share_of_year"] = with_ctes(
    "act",
    f"""
, t AS (
  SELECT CAST(year(fecha) AS INTEGER) AS anio,
         {", ".join(big(f"sum({m})", f"total_{m}") for m in METRICS)},
         {", ".join(big(f"sum(CASE WHEN fecha <= make_date(year(fecha), 6, 14) THEN {m} ELSE 0 END)",
                        f"avance_{m}") for m in METRICS)}
  FROM act WHERE year(fecha) IN (1998, 1999, 2000) GROUP BY year(fecha))
SELECT *, {", ".join(f"CAST(avance_{m} AS DOUBLE) / nullif(total_{m}, 0) AS pct_avance_{m}" for m in METRICS)}
FROM t""",
)

ORACLES["persons_pivot"] = with_ctes("per", "SELECT * FROM per")
ORACLES["persons_by_year"] = with_ctes("per", f"SELECT anio_insert AS anio, {', '.join(PERSONS)} FROM per")


def _window(first: str, last: str) -> str:
    """Totals per measure and year between two MM-DD days, long."""
    return " UNION ALL ".join(
        f"""
SELECT '{m}' AS procedimiento, CAST(year(fecha) AS INTEGER) AS anio, {big(f"sum({m})", "valor")},
       CAST(sum(CASE WHEN fecha_insert IS NULL OR fecha_insert <= CAST(year(fecha) || '-{last}' AS DATE)
                     THEN {m} ELSE 0 END) AS BIGINT) AS valor_fecha_insert
FROM act WHERE year(fecha) BETWEEN 1997 AND 2000 AND strftime(fecha, '%m-%d') BETWEEN '{first}' AND '{last}'
GROUP BY year(fecha)"""
        for m in METRICS
    )


ORACLES["period_summary"] = with_ctes(
    "act",
    f"""
, w AS ({_window("03-01", "06-14")}),
f AS (SELECT procedimiento, anio, valor,
             CASE WHEN anio = 1998 THEN valor ELSE valor_fecha_insert END AS valor_fecha_insert FROM w)
SELECT *, valor - valor_fecha_insert AS diferencia FROM f""",
)

ORACLES["sum_periods"] = with_ctes(
    "act",
    f"""
, a AS ({_window("05-01", "05-31")}), b AS ({_window("06-01", "06-30")}), c AS ({_window("07-01", "07-31")})
SELECT procedimiento, anio, a.valor + b.valor + c.valor AS valor,
       a.valor_fecha_insert + b.valor_fecha_insert + c.valor_fecha_insert AS valor_fecha_insert,
       a.valor + b.valor + c.valor - a.valor_fecha_insert - b.valor_fecha_insert - c.valor_fecha_insert AS diferencia
FROM a FULL JOIN b USING (procedimiento, anio) FULL JOIN c USING (procedimiento, anio)""",
)


def _late(registered: str, occurred: str, first: str, last: str) -> str:
    """Late-registration decomposition: conditions over act, nowcast between two days."""
    year = "year(fecha)"
    per_metric = " UNION ALL ".join(
        f"""
SELECT '{m}' AS procedimiento, s.anio,
       coalesce((SELECT CAST(sum({m}) AS DOUBLE) FROM act WHERE {year} = s.anio AND {registered}), 0)
         AS valor_fecha_insert,
       CASE WHEN s.anio = 2000
            THEN coalesce((SELECT sum({m}) FROM now_day WHERE fecha BETWEEN {first} AND {last}), 0)
            ELSE (SELECT CAST(sum({m}) AS DOUBLE) FROM act WHERE {year} = s.anio AND {occurred}) END AS ocurrido
FROM spine AS s"""
        for m in METRICS
    )
    return f"""
, spine AS (SELECT CAST(unnest([1997, 1998, 1999, 2000]) AS INTEGER) AS anio), p AS ({per_metric}),
q AS (
  SELECT procedimiento, anio, valor_fecha_insert, coalesce(ocurrido, valor_fecha_insert) AS valor_total,
         CASE WHEN anio = 1997 THEN 0 ELSE greatest(coalesce(ocurrido, valor_fecha_insert) - valor_fecha_insert, 0)
         END AS superior_graf
  FROM p),
late AS (
  SELECT procedimiento, anio, valor_fecha_insert, valor_total, CAST(superior_graf AS DOUBLE) AS superior_graf,
         valor_fecha_insert + superior_graf AS total_graf,
         CASE WHEN anio = 2000 THEN 'Proyección 2000' WHEN anio > 1997 THEN 'Registro extemporáneo' END
           AS tipo_superior,
         CAST(anio - 1996 AS INTEGER) AS x
  FROM q)"""


INS = "coalesce(fecha_insert, fecha)"
LATE_YTD = _late(
    f"year({INS}) = year(fecha) AND {INS} <= make_date(year(fecha), 6, 14)",
    "fecha <= make_date(year(fecha), 6, 14)",
    "DATE '2000-01-01'",
    CORTE,
)
LATE_MONTH = _late(
    f"month(fecha) = 6 AND year({INS}) = year(fecha) AND {INS} <= "
    "CASE WHEN year(fecha) = 1997 THEN DATE '1997-06-15' ELSE make_date(year(fecha), 6, 14) END",
    "month(fecha) = 6 AND (year(fecha) <> 1997 OR fecha <= DATE '1997-06-15')",
    "DATE '2000-06-01'",
    "DATE '2000-06-30'",
)


def _with_growth(ctes: str, formula: str) -> str:
    return with_ctes(
        "act now_day",
        f"""{ctes}
SELECT * EXCLUDE (ant), CASE WHEN anio = 2000 THEN {formula} END AS pct_incremento
FROM (SELECT *, lag(total_graf) OVER (PARTITION BY procedimiento ORDER BY anio) AS ant FROM late)""",
    )


ORACLES["late_registration_ytd"] = _with_growth(
    LATE_YTD, "round_even((total_graf - ant) / nullif(total_graf, 0) * 100, 0) + 0"
)
ORACLES["late_registration_month"] = _with_growth(
    LATE_MONTH, "round_even((total_graf / nullif(ant, 0) - 1) * 100, 0) + 0"
)
ORACLES["growth_ref_base"] = with_ctes(
    "act now_day",
    f"""{LATE_MONTH}
SELECT procedimiento, a.total_graf AS valor_referencia, b.total_graf AS valor_actual,
       round_even((b.total_graf / nullif(a.total_graf, 0) - 1) * 100, 0) + 0 AS crecimiento
FROM late AS a JOIN late AS b USING (procedimiento) WHERE a.anio = 1999 AND b.anio = 2000""",
)

ORACLES["yoy_lag"] = with_ctes(
    "act",
    f"""
, w AS ({_window("01-01", "06-14")}),
t AS (SELECT procedimiento, anio, CAST(valor AS DOUBLE) AS total, CAST(valor_fecha_insert AS DOUBLE) AS observado
      FROM w)
SELECT procedimiento, anio, total, observado, greatest(total - observado, 0) AS superior,
       CASE WHEN anio = 2000 THEN 'Proyección 2000' ELSE 'Registro extemporáneo' END AS componente_superior,
       round_even((total / nullif(lag(total) OVER (PARTITION BY procedimiento ORDER BY anio), 0) - 1) * 100, 0) + 0
         AS pct_cambio,
       total + max(total) OVER (PARTITION BY procedimiento) * 0.035::DOUBLE AS y_total,
       CASE WHEN observado > 0 THEN observado / 2 END AS y_observado
FROM t""",
)
