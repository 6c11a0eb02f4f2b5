"""Aggregates with explicit missing-value rules, and reshaping helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sum_or_zero(column: Column) -> Column:
    """Sum that skips NULLs; nothing to add gives 0."""
    return F.coalesce(F.sum(column), F.lit(0))


def strict_sum(column: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.count(column) < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(column))


def strict_sum_if(condition: Column, column: Column) -> Column:
    """Strict sum over the rows meeting ``condition``; no such row gives 0."""
    total = F.coalesce(F.sum(F.when(condition, column)), F.lit(0).cast("double"))
    return F.when(F.count_if(condition & column.isNull()) > 0, F.lit(None)).otherwise(total)


def sum_metrics(metrics: Iterable[str], condition: str | None = None, prefix: str = "") -> list[Column]:
    """Whole-number sums of several columns, optionally over the rows where a boolean column holds."""
    value = "if({c}, {m}, 0)" if condition else "{m}"
    return [
        F.expr(f"cast(coalesce(sum({value.format(c=condition, m=m)}), 0) as bigint) as {prefix}{m}") for m in metrics
    ]


def sum_where(metrics: Iterable[str], condition: str, prefix: str) -> list[Column]:
    """Sums over the rows where a boolean column holds; NULL when there is no such row."""
    return [F.expr(f"sum(if({condition}, {m}, null)) as {prefix}{m}") for m in metrics]


def melt(
    df: DataFrame,
    ids: Iterable[str | Column],
    rows: Mapping[str, Mapping[str, Column]],
    name_col: str,
) -> DataFrame:
    """Wide to long: one output row per entry of ``rows``, holding its name and its value columns."""
    structs = [
        F.struct(F.lit(name).alias(name_col), *[value.alias(column) for column, value in values.items()])
        for name, values in rows.items()
    ]
    return df.select(*ids, F.inline(F.array(*structs)))


def inline_table(spark: SparkSession, columns: Iterable[str], rows: Iterable[tuple]) -> DataFrame:
    """A constant table as a VALUES list: part of the plan, with an exact size estimate."""
    lines = ", ".join(f"({', '.join(_sql_literal(value) for value in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(columns)})")


def _sql_literal(value: str | int | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"double({value!r})" if isinstance(value, float) else str(value)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; key columns appear once, coalesced."""
    keys = list(keys)
    left, right = left.alias("l"), right.alias("r")
    condition = None
    for key in keys:
        same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        condition = same if condition is None else condition & same
    merged = [
        (F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")) if how == "full" else F.col(f"l.{key}")).alias(key)
        for key in keys
    ]
    rest_left = [F.col(f"l.{c}") for c in left.columns if c not in keys]
    rest_right = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.join(right, condition, how).select(*merged, *rest_left, *rest_right)


def may_broadcast(df: DataFrame) -> bool:
    """Whether Spark would broadcast a table in a join: its own estimate against its own limit. Starts no job."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def require_unique(df: DataFrame, key: str, label: str, null_safe: bool = False) -> DataFrame:
    """The same table, failing the job when a key repeats: a repeated dimension row would multiply counts.

    A plain equality never meets NULL keys, so they may repeat; for a null-safe join they may not.

    The check runs beside the query as a scalar subquery over keys only, so the table itself keeps its size
    estimate and Spark can still choose to broadcast it.
    """
    keys = df.select(key) if null_safe else df.select(key).where(F.col(key).isNotNull())
    keys = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = keys.where(F.col("_copies") > 1).agg(F.count(F.lit(1))).scalar()
    guard = F.when(repeated > 0, F.raise_error(F.lit(f"{label}: repeated {key}"))).otherwise(F.col(key))
    return df.withColumn(key, guard)
