"""Running sums over a whole table without a single task that holds it.

A window without PARTITION BY sends every row to one task. Here rows are
range-partitioned by the key, summed within blocks, and the few block totals
are running-summed and added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def in_blocks(df: DataFrame, *order: Column, block: str = "_block") -> DataFrame:
    """``df`` in ranges of ``order``, numbered in that order.

    Bounds of ranges are sampled and partitions may be joined at run time, so
    the table is stored with its numbers: whatever reads it sees the same ones.
    """
    return stored(df.repartitionByRange(*order).withColumn(block, F.spark_partition_id()))


def running_sum(df: DataFrame, key: str | list[Column], value: str | list[str], to: str | list[str], ascending: bool = True) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with this ``key``.

    ``key`` has to be distinct; group by it first. Several columns, each with
    its order, make one key too, so that rows with the same first column are
    dealt out by the others. Blocks follow Spark's shuffle partitions, so the
    ordered pass over their totals is bounded.
    """
    values, tos = ([value], [to]) if isinstance(value, str) else (value, to)
    order = [F.col(key).asc() if ascending else F.col(key).desc()] if isinstance(key, str) else key
    ranged = in_blocks(df, *order)
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.withColumns({t: F.sum(v).over(inside) for v, t in zip(values, tos)})
    totals = ranged.groupBy("_block").agg(*[F.sum(v).alias(f"_{t}") for v, t in zip(values, tos)])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_block", *[F.coalesce(F.sum(f"_{t}").over(before), F.lit(0.0)).alias(f"_{t}") for t in tos])
    joined = sums.join(F.broadcast(ahead), "_block")  # one row a shuffle partition
    return joined.withColumns({t: F.col(t) + F.col(f"_{t}") for t in tos}).drop("_block", *[f"_{t}" for t in tos])
