"""Constraints as queries for what violates them, and referential actions as semi-joins to a fixed point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.errors import CheckViolation, EngineError, ForeignKeyViolation, NotNullViolation, UniqueViolation
from rivulet.schema import Catalog, TableSpec
from rivulet.types import out_of_range

#: Steps that cascades and triggers may take.
DEPTH = 64


def with_computed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Computed columns from their expressions, in order, whatever the rows held."""
    for c in spec.columns:
        if c.computed:
            df = df.withColumn(c.name, F.expr(c.computed).cast(c.kind.spark))
    return df


def null_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    missing = F.array_compact(F.array(*(F.when(F.col(c.name).isNull(), F.lit(c.name)) for c in spec.columns if not c.nullable)))
    return df.select(*spec.primary_key, missing.alias("columns")).where(F.size("columns") > 0)


def check_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A check fails where it is false; null passes, as in SQL. Values outside their logical type fail as well."""
    tests = [F.when(~F.expr(c.check), F.lit(c.name)) for c in spec.columns if c.check]
    tests += [F.when(out_of_range(c.name, c.kind), F.lit(c.name)) for c in spec.columns if c.kind.integer]
    rtree = spec.index("rtree")
    if rtree:
        x0, y0, x1, y1 = map(F.col, rtree.columns)
        tests.append(F.when(~((x0 <= x1) & (y0 <= y1)), F.lit("rtree")))
    if not tests:
        return df.select(*spec.primary_key, F.array().cast("array<string>").alias("failed")).where(F.lit(False))
    return df.select(*spec.primary_key, F.array_compact(F.array(*tests)).alias("failed")).where(F.size("failed") > 0)


def unique_violations(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys of the state after a batch that several rows have; swaps within a batch are fine. Nulls are equal."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, references: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(references).alias(column)), column, "left_anti")


def children_of(child: DataFrame, column: str, gone: DataFrame, references: str) -> DataFrame:
    return child.join(gone.select(F.col(references).alias(column)).distinct(), column, "left_semi")


def validate(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame] = {}) -> None:
    """Raise the coded error of the first constraint that rows of the state after a batch violate."""

    def refuse(bad: DataFrame, kind: type[EngineError], what: str) -> None:
        row = bad.first()
        if row is not None:
            raise kind(f"{spec.name}: {what}: {row.asDict()}")

    refuse(null_violations(df, spec), NotNullViolation, "null")
    refuse(check_violations(df, spec), CheckViolation, "check")
    for columns in (spec.primary_key, *spec.unique):
        refuse(unique_violations(df, columns), UniqueViolation, "not unique")
    for f in spec.foreign_keys:
        if f.table in parents:
            refuse(missing_parents(df, f.column, parents[f.table], f.references).select(*spec.primary_key, f.column), ForeignKeyViolation, f"no {f.table}")


def delete_with_actions(tables: dict[str, DataFrame], catalog: Catalog, table: str, gone: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All tables after rows of one are deleted: children are deleted too, set to null, or refuse.

    Cascades follow a worklist of deleted rows; rows that are gone already are not followed again, so cycles end.
    ``checkpoint`` cuts lineage between steps of long cascades.
    """
    out = dict(tables)
    out[table] = out[table].join(gone.select(*catalog.table(table).primary_key), list(catalog.table(table).primary_key), "left_anti")
    work = [(table, gone, 0)]
    while work:
        name, dead, depth = work.pop()
        if depth >= DEPTH:
            raise EngineError(f"cascade deeper than {DEPTH}")
        for spec in catalog.tables.values():
            for f in (f for f in spec.foreign_keys if f.table == name and spec.name in out):
                hit = children_of(out[spec.name], f.column, dead, f.references)
                if f.on_delete == "restrict":
                    row = hit.select(*spec.primary_key).first()
                    if row is not None:
                        raise ForeignKeyViolation(f"{spec.name} {row.asDict()} refers to {name}")
                elif f.on_delete == "set_null":
                    keys = hit.select(*spec.primary_key).withColumn("_hit", F.lit(True))
                    cleared = F.when(F.col("_hit").isNull(), F.col(f.column))
                    out[spec.name] = out[spec.name].join(keys, list(spec.primary_key), "left").withColumn(f.column, cleared).select(*tables[spec.name].columns)
                else:
                    hit = checkpoint(hit)
                    if not hit.isEmpty():
                        out[spec.name] = checkpoint(out[spec.name].join(hit.select(*spec.primary_key), list(spec.primary_key), "left_anti"))
                        work.append((spec.name, hit, depth + 1))
    return out


Trigger = Callable[[str, DataFrame], dict[str, DataFrame]]


def run_triggers(changes: dict[str, DataFrame], triggers: dict[str, list[Trigger]], event: str = "insert") -> dict[str, DataFrame]:
    """Rows to write after triggers have added theirs: ``trigger(event, rows)`` returns more rows by table."""
    out = dict(changes)
    fresh, depth = changes, 0
    while fresh:
        if depth >= DEPTH:
            raise EngineError(f"triggers nested deeper than {DEPTH}")
        more: dict[str, DataFrame] = {}
        for table, rows in fresh.items():
            for trigger in triggers.get(table, ()):
                for name, added in trigger(event, rows).items():
                    more[name] = added if name not in more else more[name].unionByName(added)
        more = {t: df for t, df in more.items() if not df.isEmpty()}
        for t, df in more.items():
            out[t] = df if t not in out else out[t].unionByName(df)
        fresh, depth = more, depth + 1
    return out
