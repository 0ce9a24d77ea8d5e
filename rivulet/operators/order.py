"""Numbering rows of any number in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.sources.shared import materialize


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order``.

    Rows are range-partitioned and sorted once and written with their partition and place, since a second run of the
    sampled partitioning may cut elsewhere; then each partition starts where those before it end.
    """
    order = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").count()  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_id", "_start")
