"""Many additive views of the same rows from one scan and one aggregation.

A view is a condition on rows, the whole number they are grouped by, and the measures added up. Views are compiled into
conditional sums over the groups of all of them together, which is what crosses the shuffle: one row per task and
combination of groups, whatever the number of rows or views. That small table is then opened into one row per view and
group, so views may group by different columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import sum_metrics


@dataclass(frozen=True)
class View:
    """Rows that meet ``where``, grouped by one of the named groups."""

    name: str
    group: str
    where: Column


def compile_views(
    rows: DataFrame, views: Sequence[View], groups: Mapping[str, Column], measures: Sequence[str]
) -> DataFrame:
    """vista, grupo, filas and the sum of every measure: a row for each view and group that has rows.

    The conditions' union is a filter, so date ranges common to all views reach the scan. A NULL condition keeps a row
    out of its view; a NULL group is a group.
    """
    flags = {view.name: f"_v{k}" for k, view in enumerate(views)}
    marked = rows.where(reduce(Column.__or__, [view.where for view in views])).select(
        *[column.cast("int").alias(f"_g_{name}") for name, column in groups.items()],
        *[F.coalesce(view.where, F.lit(False)).alias(flags[view.name]) for view in views],
        *measures,
    )
    sums = [
        column
        for flag in flags.values()
        for column in (F.count_if(F.col(flag)).alias(f"{flag}_n"), *sum_metrics(measures, flag, f"{flag}_"))
    ]
    wide = marked.groupBy(*[f"_g_{name}" for name in groups]).agg(*sums)
    cells = [
        F.struct(
            F.lit(view.name).alias("vista"),
            F.col(f"_g_{view.group}").alias("grupo"),
            F.col(f"{flags[view.name]}_n").alias("filas"),
            *[F.col(f"{flags[view.name]}_{m}").alias(m) for m in measures],
        )
        for view in views
    ]
    long = wide.select(F.inline(F.array(*cells))).where(F.col("filas") > 0)
    if len(groups) == 1:
        return long
    return long.groupBy("vista", "grupo").agg(F.sum("filas").alias("filas"), *sum_metrics(measures))
