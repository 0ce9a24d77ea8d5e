"""Materialized views: one aggregate over at most one grouping column, or a top-N window; whole and incremental.

An incremental view keeps a state table that a batch of signed rows changes: per group the row count and sum, for
minima and maxima also a count for each value. A batch is first summed by key, so what is merged has one row for each key
touched, however many changes a key had. Only changed keys are put out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.errors import Unsupported

GLOBAL = "*"


@dataclass(frozen=True)
class MatView:
    """aggregate (count, sum, avg, min, max) of ``column`` by ``group_by``; or the first ``limit`` rows by ``order_by``."""

    name: str
    table: str
    aggregate: str | None = None
    column: str | None = None
    group_by: str | None = None
    order_by: str | None = None
    desc: bool = True
    limit: int | None = None
    key: str | None = None  # the primary key, for top-N

    def __post_init__(self):
        if (self.aggregate is None) == (self.order_by is None):
            raise Unsupported(f"{self.name}: a view has one aggregate or one order")
        if self.aggregate not in (None, "count", "sum", "avg", "min", "max"):
            raise Unsupported(f"{self.name}: aggregate {self.aggregate}")
        if (self.aggregate not in (None, "count")) and self.column is None:
            raise Unsupported(f"{self.name}: {self.aggregate} needs a column")
        if self.order_by and (self.limit is None or self.key is None):
            raise Unsupported(f"{self.name}: a top-N view needs a limit and a key")

    @property
    def group(self) -> Column:
        return F.col(self.group_by) if self.group_by else F.lit(GLOBAL)


def compute(view: MatView, df: DataFrame) -> DataFrame:
    """(group, value), without rows for an empty table; or (rank, value, key)."""
    if view.order_by:
        return top_n(view, df)
    value = {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(_exact(df, view.column)),
        # The mean is over all rows of the group; nulls add nothing to the sum.
        "avg": lambda: F.sum(F.col(view.column).cast("double")) / F.count(F.lit(1)),
        "min": lambda: F.min(view.column),
        "max": lambda: F.max(view.column),
    }[view.aggregate]()
    return df.groupBy(view.group.alias("group")).agg(value.alias("value"))


def _exact(df: DataFrame, column: str) -> Column:
    """Integers are summed as decimals, which do not overflow."""
    kind = df.schema[column].dataType.typeName()
    return F.col(column).cast("decimal(28,0)") if kind in ("byte", "short", "integer", "long") else F.col(column)


def top_n(view: MatView, df: DataFrame) -> DataFrame:
    order = [F.desc_nulls_last(view.order_by) if view.desc else F.asc_nulls_first(view.order_by), F.asc(view.key)]
    head = df.select(F.col(view.order_by), F.col(view.key)).orderBy(*order).limit(view.limit)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over ``limit`` rows
    return ranked.select("rank", F.col(view.order_by).alias("value"), F.col(view.key).alias("key"))


def signed(inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Changes as rows with ``sign``: 1 for what came, -1 for what went; an update is both."""
    return inserts.withColumn("sign", F.lit(1)).unionByName(deletes.withColumn("sign", F.lit(-1)))


def state_of(view: MatView, df: DataFrame) -> DataFrame:
    return merge_state(view, None, df.withColumn("sign", F.lit(1)))


def merge_state(view: MatView, state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The state after a batch. Keys whose count falls to zero are gone."""
    sign = F.col("sign").cast("long")
    if view.order_by:
        keep = [F.col(view.order_by).alias("value"), F.col(view.key).alias("key"), sign.alias("n")]
        rows = changes.select(*keep)
        rows = rows if state is None else state.unionByName(rows)
        return rows.groupBy("value", "key").agg(F.sum("n").alias("n")).where("n > 0")
    if view.aggregate in ("min", "max"):
        rows = changes.select(view.group.alias("group"), F.col(view.column).alias("v"), sign.alias("n")).groupBy("group", "v").agg(F.sum("n").alias("n"))
        rows = rows if state is None else state.unionByName(rows)
        return rows.groupBy("group", "v").agg(F.sum("n").alias("n")).where("n > 0")
    value = F.lit(0).cast("decimal(28,0)") if view.aggregate == "count" else _exact(changes, view.column) * F.col("sign")
    rows = changes.select(view.group.alias("group"), F.coalesce(value, F.lit(0)).alias("s"), sign.alias("n"))
    rows = rows.groupBy("group").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = rows if state is None else state.unionByName(rows)
    return rows.groupBy("group").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")


def read_state(view: MatView, state: DataFrame) -> DataFrame:
    """The view's rows from its state."""
    if view.order_by:
        rows = state.select(F.col("value").alias(view.order_by), F.col("key").alias(view.key))
        return top_n(view, rows)
    if view.aggregate in ("min", "max"):
        return state.groupBy("group").agg((F.min if view.aggregate == "min" else F.max)("v").alias("value"))
    value = {"count": F.col("n"), "sum": F.col("s"), "avg": F.col("s").cast("double") / F.col("n")}[view.aggregate]
    return state.select("group", value.alias("value"))


def view_delta(view: MatView, before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, row before, row after) of the keys that differ: insert, delete or update."""
    key = "rank" if view.order_by else "group"
    rest = [c for c in after.columns if c != key]
    old = before.select(F.col(key).alias("k"), F.struct(*rest).alias("old"))
    new = after.select(F.col(key).alias("k"), F.struct(*rest).alias("new"))
    joined = old.join(new, old.k.eqNullSafe(new.k), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return joined.select(op.alias("op"), F.coalesce(old.k, new.k).alias(key), "old", "new")


def agrees(view: MatView, state: DataFrame, df: DataFrame) -> bool:
    """Whether the incremental rows are those of a full computation; sums of doubles, which depend on their order, to 9 digits."""
    mine, whole = read_state(view, state), compute(view, df)
    if view.aggregate in ("sum", "avg") and whole.schema["value"].dataType.typeName() in ("double", "float"):
        one, other = mine.select("group", F.col("value").alias("a")), whole.select(F.col("group").alias("g"), F.col("value").alias("b"))
        both = one.join(other, one.group.eqNullSafe(other.g), "full_outer")
        near = F.abs(F.col("a") - F.col("b")) <= 1e-9 * F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0))
        return both.where(~(F.coalesce(near, F.lit(False)) | F.col("a").eqNullSafe(F.col("b")))).isEmpty()
    return mine.exceptAll(whole).isEmpty() and whole.exceptAll(mine).isEmpty()
