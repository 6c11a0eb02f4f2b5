"""Row numbers over a whole table without sending the table through one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sketch for each bucket, and buckets at most: together they bound what a task holds of the sketch.
SKETCH_PER_BUCKET, MOST_BUCKETS = 16, 1024


@dataclass(frozen=True)
class Order:
    """One key of an order: ascending unless said otherwise, NULL last."""

    column: Column
    descending: bool = False

    def sort_key(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_last()


def _before(bound: Column, names: Sequence[str], order: Sequence[Order]) -> Column:
    """Whether a sketch's row stands before this one, key by key."""
    earlier, equal = F.lit(False), F.lit(True)
    for name, key in zip(names, order):
        there, here = bound[name], F.col(name)
        less = there > here if key.descending else there < here
        # NULL stands last: a bound without a value is before nothing, any value is before a row without one.
        less = there.isNotNull() & (here.isNull() | F.coalesce(less, F.lit(False)))
        earlier = earlier | (equal & less)
        equal = equal & there.eqNullSafe(here)
    return earlier


def global_row_number(
    df: DataFrame,
    order_by: Sequence[Order],
    rank_col: str = "posicion",
    total_col: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Number rows 1..n in a total order, as one lazy plan.

    A window without PARTITION BY would collect every row in one task. Here each row's bucket is a function of the row:
    the number of a sketch's bounds that stand before it. The sketch is the rows with the smallest hashes of their keys,
    a sample of fixed size whatever the table's, which each task cuts down by itself; the bounds are evenly spaced among
    them. They are whole keys, so rows tied in the first ones are still dealt to several buckets. Rows are numbered
    within buckets, and only one row per bucket (its size) is summed up to give its starting rank. All of it runs when
    the result does: nothing is computed, written or checkpointed while the plan is made, and a lost executor repeats
    what it lost, as no boundary depends on how rows lie in partitions.

    ``order_by`` must end in a key that breaks all ties; rows equal in all keys get consecutive numbers in any order.
    """
    keys = [f"_key{k}" for k in range(len(order_by))]
    keyed = df.withColumns({name: key.column for name, key in zip(keys, order_by)})
    wanted = min(MOST_BUCKETS, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = SKETCH_PER_BUCKET * wanted
    sample = keyed.select(*keys).orderBy(F.xxhash64(*keys)).limit(size)
    in_order = Window.orderBy(*[Order(F.col(n), k.descending).sort_key() for n, k in zip(keys, order_by)])
    # At most `size` rows, so this window is small.
    placed = sample.withColumn("_place", F.row_number().over(in_order))
    bounds = placed.where(F.col("_place") % SKETCH_PER_BUCKET == 0)
    bounds = bounds.agg(F.collect_list(F.struct(*keys))).scalar()
    # A column first: higher-order functions take no subqueries.
    bucket = F.size(F.filter("_bounds", lambda bound: _before(bound, keys, order_by)))
    dealt = keyed.withColumn("_bounds", bounds).withColumn("_bucket", bucket).drop("_bounds")
    inside = Window.partitionBy("_bucket").orderBy(
        *[Order(F.col(name), key.descending).sort_key() for name, key in zip(keys, order_by)]
    )
    numbered = dealt.withColumn("_inside", F.row_number().over(inside))
    # One row per bucket.
    sizes = dealt.groupBy(F.col("_bucket").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    running = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(
        "_of",
        (F.sum("_size").over(running) - F.col("_size")).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    columns = [*df.columns, (F.col("_start") + F.col("_inside")).cast("bigint").alias(rank_col)]
    if total_col:
        columns.append(F.col("_total").alias(total_col))
    return numbered.join(F.broadcast(starts), F.col("_bucket") == F.col("_of")).select(*columns)
