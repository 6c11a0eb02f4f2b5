"""Shared pieces of the oracle SQL: the model tables rebuilt from the star schema."""

from __future__ import annotations

METRICS = (
    "consultas_totales",
    "consultas_generales",
    "consultas_de_especialidad",
    "procedimientos_quirurgicos",
    "egresos",
)
PERSONS = (
    "personas_consulta_total",
    "personas_general",
    "personas_especialidad",
    "personas_qx",
    "personas_egresos",
)

# Report cut-off, expected share of the target at its week, the same in percent.
CORTE = "DATE '2000-06-14'"
SHARE = "(CAST(23 AS DOUBLE) / CAST(52 AS DOUBLE))"
PCT = "(CAST(2300 AS DOUBLE) / CAST(52 AS DOUBLE))"

# Annual targets.
TARGETS = {
    "consultas_totales": 60000000,
    "consultas_generales": 52500000,
    "consultas_de_especialidad": 7500000,
    "procedimientos_quirurgicos": 1100000,
    "egresos": 1600000,
}

CTES: dict[str, str] = {}

CTES["lines"] = """
SELECT 'IMB' || printf('%05d', l_suppkey) AS clues, l_suppkey AS k, CAST(l_shipdate AS DATE) AS fecha,
       CAST(year(l_shipdate) AS INTEGER) AS y,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS ins,
       l_returnflag AS flag, l_linenumber % 4 AS archivo,
       l_linestatus = 'F' AND l_discount >= 0.05 AND l_suppkey % 10 <> 3 AS cir,
       l_linestatus = 'O' AND l_tax >= 0.04 AS egr
FROM lineitem"""

CTES["cat"] = """
SELECT 'IMB' || printf('%05d', s_suppkey) AS clues_imb, 'SSA' || printf('%05d', s_suppkey) AS clues_ssa_y_sme,
       upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS entidad, s_name AS nombre_comercial,
       CASE WHEN s_suppkey % 10 = 0 THEN 'UNEME' WHEN s_suppkey % 10 = 1 THEN NULL ELSE 'Hospital' END
         AS categoria_gerencial,
       s_suppkey AS k
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

CTES["goals"] = """
SELECT 'IMB' || printf('%05d', s_suppkey) AS clues_imb,
       upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS entidad,
       CAST(20 + s_suppkey % 30 AS DOUBLE) AS meta_general_anual,
       CAST(15 + s_suppkey % 20 AS DOUBLE) AS meta_especialidad_anual,
       CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 11 = 0 THEN NULL ELSE 10 + s_suppkey % 90 END
            AS DOUBLE) AS meta_cirugia_anual,
       CAST(15 + s_suppkey % 25 AS DOUBLE) AS meta_egresos_anual
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

CTES["hist"] = """
SELECT CASE WHEN regexp_matches(c.code, 'IMB') THEN c.code ELSE cat.clues_imb END AS clues, c.fecha,
       c.consultas_totales, c.consultas_generales, c.consultas_de_especialidad,
       c.procedimientos_quirurgicos, c.egresos
FROM (
  SELECT CASE WHEN k % 2 = 1 THEN 'SSA' ELSE 'IMB' END || printf('%05d', k) AS code, fecha,
         count(*) AS consultas_totales, count(*) FILTER (flag = 'N') AS consultas_generales,
         count(*) FILTER (flag = 'R') AS consultas_de_especialidad,
         count(*) FILTER (cir) AS procedimientos_quirurgicos, count(*) FILTER (egr) AS egresos
  FROM lines WHERE y <= 1997 GROUP BY k, fecha
) AS c LEFT JOIN cat ON c.code = cat.clues_ssa_y_sme
WHERE regexp_matches(c.code, 'IMB') OR cat.clues_imb IS NOT NULL"""

CTES["recs"] = f"""
SELECT * FROM lines WHERE y IN (1998, 1999) OR (y >= 2000 AND ins <= {CORTE})"""

CTES["act"] = """
SELECT clues, fecha, CAST(NULL AS DATE) AS fecha_insert, consultas_totales, consultas_generales,
       consultas_de_especialidad, procedimientos_quirurgicos, egresos FROM hist
UNION ALL
SELECT clues, fecha, ins, 1, CASE WHEN flag = 'N' THEN 1 ELSE 0 END, CASE WHEN flag = 'R' THEN 1 ELSE 0 END,
       CASE WHEN cir THEN 1 ELSE 0 END, CASE WHEN egr THEN 1 ELSE 0 END FROM recs"""

# Month-and-day comparison as text, whole table: 'MM-DD' up to the cut-off's.
CTES["ytd"] = f"""
SELECT CAST(year(fecha) AS INTEGER) AS anio, {", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in METRICS)}
FROM act WHERE strftime(fecha, '%m-%d') <= '06-14' GROUP BY 1"""

CTES["now_type"] = """
SELECT CAST(o_orderdate AS DATE) AS fecha, o_custkey,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'general' WHEN '2' THEN 'especialidad' WHEN '3' THEN 'qx'
            WHEN '4' THEN 'egresos' END AS tipo
FROM orders WHERE o_orderdate >= DATE '2000-01-01'"""

CTES["now_day"] = """
SELECT fecha,
       1.25::DOUBLE * count(*) FILTER (tipo IN ('general', 'especialidad')) AS consultas_totales,
       1.25::DOUBLE * count(*) FILTER (tipo = 'general') AS consultas_generales,
       1.25::DOUBLE * count(*) FILTER (tipo = 'especialidad') AS consultas_de_especialidad,
       1.25::DOUBLE * count(*) FILTER (tipo = 'qx') AS procedimientos_quirurgicos,
       1.25::DOUBLE * count(*) FILTER (tipo = 'egresos') AS egresos
FROM now_type GROUP BY fecha"""

CTES["now_state"] = f"""
SELECT upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS entidad,
       CAST(count(*) FILTER (tipo IN ('general', 'especialidad')) AS DOUBLE) AS consultas_totales,
       CAST(count(*) FILTER (tipo = 'general') AS DOUBLE) AS consultas_generales,
       CAST(count(*) FILTER (tipo = 'especialidad') AS DOUBLE) AS consultas_de_especialidad,
       CAST(count(*) FILTER (tipo = 'qx') AS DOUBLE) AS procedimientos_quirurgicos,
       CAST(count(*) FILTER (tipo = 'egresos') AS DOUBLE) AS egresos
FROM now_type JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE fecha <= {CORTE} GROUP BY 1"""

_KINDS = {"consulta_total": "5", "general": "1", "especialidad": "2", "qx": "3", "egresos": "4"}
CTES["per"] = f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS anio_insert, 'NACIONAL' AS id,
       {", ".join(f"count(*) FILTER (left(o_orderpriority, 1) = '{d}') AS procedimientos_{n}"
                  for n, d in _KINDS.items())},
       {", ".join(f"count(DISTINCT o_custkey) FILTER (left(o_orderpriority, 1) = '{d}') AS personas_{n}"
                  for n, d in _KINDS.items())}
FROM orders GROUP BY 1"""

CTES["kpi"] = f"""
SELECT m.*, {", ".join(f"p.{c}" for c in PERSONS)}
FROM (
  SELECT CAST(anio AS VARCHAR) AS anio, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in METRICS)}
  FROM ytd WHERE anio <> 2000
  UNION ALL
  SELECT '2000', {", ".join(f"coalesce(sum({m}), 0)" for m in METRICS)} FROM now_day
) AS m LEFT JOIN per AS p ON m.anio = CAST(p.anio_insert AS VARCHAR)"""

CTES["goal_state"] = """
SELECT entidad,
       coalesce(sum(meta_general_anual), 0) + coalesce(sum(meta_especialidad_anual), 0) AS meta_total,
       coalesce(sum(meta_general_anual), 0) AS meta_cg, coalesce(sum(meta_especialidad_anual), 0) AS meta_ce,
       coalesce(sum(meta_cirugia_anual), 0) AS meta_pq, coalesce(sum(meta_egresos_anual), 0) AS meta_egresos
FROM goals GROUP BY entidad"""

INDICATORS = (
    ("cg", "consultas_generales", "meta_cg", "0.06"),
    ("ce", "consultas_de_especialidad", "meta_ce", "0.05"),
    ("pq", "procedimientos_quirurgicos", "meta_pq", "0.0638"),
    ("egresos", "egresos", "meta_egresos", "0.05"),
)
CTES["share"] = " UNION ALL ".join(
    f"""
SELECT '{name}' AS indicador, s.entidad, s.{metric} AS avance_total, s.{metric} * 1.25::DOUBLE AS avance_modelo,
       g.{goal} AS meta_total, s.{metric} / g.{goal} AS pct_avance_entidad,
       s.{metric} * 1.25::DOUBLE / g.{goal} AS pct_modelo_entidad
FROM now_state AS s JOIN goal_state AS g ON s.entidad = g.entidad WHERE g.{goal} > 0"""
    for name, metric, goal, _ in INDICATORS
)

_DEPENDS = {
    "hist": ("lines", "cat"),
    "recs": ("lines",),
    "act": ("hist", "recs"),
    "ytd": ("act",),
    "now_day": ("now_type",),
    "now_state": ("now_type",),
    "kpi": ("ytd", "now_day", "per"),
    "goal_state": ("goals",),
    "share": ("now_state", "goal_state"),
}


def depends(name: str, *on: str) -> None:
    _DEPENDS[name] = on


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _DEPENDS.get(name, ()):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_ctes(uses: str, body: str) -> str:
    """``body`` below the named CTEs and everything they need."""
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in _closure(uses.split()))
    return f"WITH {parts}\n{body}" if parts else body


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def sums(*, by: str = "") -> str:
    return ", ".join(big(f"sum({m})", m) for m in METRICS)


def growth(cur: str, ref: str) -> str:
    """Growth measured on the current value; adding 0 turns a negative zero into zero."""
    return f"(round_even(({cur} - {ref}) / nullif({cur}, 0) * 100, 0) + 0)"


def thousands(expr: str) -> str:
    return f"format('{{:,}}', CAST(trunc({expr}) AS BIGINT))"


def percent(expr: str) -> str:
    return f"CAST(CAST(round_even({expr} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


def plain(expr: str) -> str:
    """At most one decimal, none for whole numbers."""
    return (
        f"CASE WHEN round_even({expr}, 1) = trunc({expr}) THEN CAST(CAST({expr} AS BIGINT) AS VARCHAR) "
        f"ELSE printf('%.1f', round_even({expr}, 1)) END"
    )


def short_scale(expr: str) -> str:
    def tenth(unit: str) -> str:
        return f"printf('%.1f', round_even({expr} / CAST({unit} AS DOUBLE), 0) / 10)"

    return (
        f"CASE WHEN {expr} >= 1e12 THEN {tenth('1e11')} || 'T' WHEN {expr} >= 1e9 THEN {tenth('1e8')} || 'B' "
        f"WHEN {expr} >= 1e6 THEN {tenth('1e5')} || 'M' WHEN {expr} >= 1e3 THEN {tenth('1e2')} || 'K' "
        f"ELSE printf('%.1f', CAST({expr} AS DOUBLE)) END"
    )


def light(value: str, expected: str) -> str:
    return (
        f"CASE WHEN {value} < {expected} * 0.6::DOUBLE THEN 'rojo' WHEN {value} < {expected} * 0.8::DOUBLE THEN "
        f"'amarillo' WHEN {value} < {expected} * 0.95::DOUBLE THEN 'verde_claro' ELSE 'verde_fuerte' END"
    )
