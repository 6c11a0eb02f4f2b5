"""Schemas of the source tables.

Declared at read for dimensions and model output. Record files and the history are brought to their schemas after the
read, days excepted, which come as dates, timestamps or text.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from tidemark.params import METRICS


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


FACILITY_CATALOG = _struct(
    clues_imb=StringType(),
    clues_ssa_y_sme=StringType(),
    entidad=StringType(),
    nombre_comercial=StringType(),
    categoria_gerencial=StringType(),
)

FACILITY_TARGETS = _struct(
    clues_imb=StringType(),
    entidad=StringType(),
    meta_general_anual=DoubleType(),
    meta_especialidad_anual=DoubleType(),
    meta_cirugia_anual=DoubleType(),
    meta_egresos_anual=DoubleType(),
)

HISTORY_CUBE = _struct(
    clues=StringType(), anio=IntegerType(), fecha=DateType(), **{metric: LongType() for metric in METRICS}
)

VISITS = _struct(
    clues=StringType(),
    fecha_consulta=TimestampNTZType(),
    fecha_insert=TimestampNTZType(),
    tipo_consulta=StringType(),
)

# Surgeries and discharges share one layout.
EPISODES = _struct(clues=StringType(), fecha_egreso=TimestampNTZType(), fecha_insert=TimestampNTZType())

PERSON_COUNTS = _struct(
    anio_insert=IntegerType(),
    id=StringType(),
    tipo_procedimiento=StringType(),
    procedimientos=LongType(),
    personas=LongType(),
)

NOWCAST_NATIONAL = _struct(
    dia=DateType(), tipo_consulta=StringType(), nowcast=DoubleType(), observadas=DoubleType()
)

NOWCAST_STATE = _struct(
    dia=DateType(),
    tipo_consulta=StringType(),
    nowcast=DoubleType(),
    observadas=DoubleType(),
    entidad=StringType(),
)

EXCLUDED_HOSPITALS = _struct(clues_imb_hbc=StringType())

MONTHLY_SERIES = _struct(fecha=DateType(), consultas_totales=DoubleType())

DAILY_FACT = StructType(
    [
        StructField("clues", StringType(), True),
        StructField("fecha", DateType(), False),
        StructField("fecha_insert", DateType(), True),
        *[StructField(metric, LongType(), True) for metric in METRICS],
    ]
)

LINEITEM = _struct(
    l_orderkey=LongType(),
    l_partkey=LongType(),
    l_suppkey=LongType(),
    l_linenumber=IntegerType(),
    l_quantity=DoubleType(),
    l_extendedprice=DoubleType(),
    l_discount=DoubleType(),
    l_tax=DoubleType(),
    l_returnflag=StringType(),
    l_linestatus=StringType(),
    l_shipdate=TimestampNTZType(),
)

ORDERS = _struct(
    o_orderkey=LongType(),
    o_custkey=LongType(),
    o_orderstatus=StringType(),
    o_totalprice=DoubleType(),
    o_orderdate=TimestampNTZType(),
    o_orderpriority=StringType(),
)

CUSTOMER = _struct(
    c_custkey=LongType(),
    c_name=StringType(),
    c_nationkey=IntegerType(),
    c_acctbal=DoubleType(),
    c_mktsegment=StringType(),
)

SUPPLIER = _struct(s_suppkey=LongType(), s_name=StringType(), s_nationkey=IntegerType(), s_acctbal=DoubleType())

NATION = _struct(n_nationkey=IntegerType(), n_name=StringType(), n_regionkey=IntegerType())

STAR_TABLES = {
    "lineitem": LINEITEM,
    "orders": ORDERS,
    "customer": CUSTOMER,
    "supplier": SUPPLIER,
    "nation": NATION,
}
