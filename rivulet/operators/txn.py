"""Transactions over a set of tables: staged writes, overlay reads, constraints and triggers, one atomic outcome.

A transaction holds DataFrames only; nothing is written before ``commit``, which returns the tables as they are then
and what changed. An error leaves the tables as they were. A procedure is a function of a transaction and arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import EngineError
from rivulet.operators import changes as CH
from rivulet.operators import constraints as CO
from rivulet.operators.select import Eq, condition
from rivulet.schema import Catalog, TableSpec

#: How deep procedures may call each other.
DEPTH = 64


class Transaction:
    def __init__(self, catalog: Catalog, tables: dict[str, DataFrame], triggers: dict[str, list[CO.Trigger]] | None = None):
        self.catalog, self.committed, self.triggers = catalog, dict(tables), triggers or {}
        self.upserts: dict[str, DataFrame] = {}
        self.deletes: dict[str, DataFrame] = {}
        self._depth = 0

    def _spec(self, table: str) -> TableSpec:
        return self.catalog.table(table)

    def _key(self, table: str) -> list[str]:
        return list(self._spec(table).primary_key)

    # Reads

    def snapshot(self, table: str) -> DataFrame:
        """What was committed before this transaction."""
        return self.committed[table]

    def scan_pending(self, table: str) -> DataFrame:
        return self.upserts.get(table, self.committed[table].limit(0))

    def scan(self, table: str) -> DataFrame:
        """Committed rows under this transaction's own writes."""
        gone = self.deletes.get(table, self.committed[table].limit(0).select(*self._key(table)))
        return CH.overlay(self.committed[table], self.scan_pending(table), gone, self._key(table))

    def get(self, table: str, *key) -> DataFrame:
        rows = self.scan(table)
        for name, value in zip(self._spec(table).primary_key, key, strict=True):
            rows = rows.where(condition(Eq(name, value), self._spec(table)))
        return rows

    # Writes

    def _stage(self, table: str, rows: DataFrame) -> None:
        key = self._key(table)
        pending = self.upserts.get(table)
        self.upserts[table] = rows if pending is None else CH.upsert(pending, rows, key)
        if table in self.deletes:
            self.deletes[table] = self.deletes[table].join(rows.select(*key), key, "left_anti")

    def insert(self, table: str, rows: DataFrame) -> None:
        rows = CO.with_computed(rows, self._spec(table))
        CH.insert(self.scan(table), rows, self._key(table))
        self._stage(table, rows)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows that equal what is there are no change."""
        rows = CO.with_computed(rows, self._spec(table))
        self._stage(table, CH.effective(self.scan(table), rows, self._key(table)))

    def delete(self, table: str, keys: DataFrame) -> None:
        key = self._key(table)
        keys = keys.select(*key).distinct()
        if table in self.upserts:
            self.upserts[table] = CH.delete(self.upserts[table], keys, key)
        gone = keys.join(self.committed[table].select(*key), key, "left_semi")
        self.deletes[table] = gone if table not in self.deletes else self.deletes[table].unionByName(gone).distinct()

    def delete_where(self, table: str, predicate: Column) -> None:
        self.delete(table, self.scan(table).where(F.coalesce(predicate, F.lit(False))))

    def call(self, procedure: Callable, *args):
        """A nested procedure, in the same transaction."""
        if self._depth >= DEPTH:
            raise EngineError(f"procedures nested deeper than {DEPTH}")
        self._depth += 1
        try:
            return procedure(self, *args)
        finally:
            self._depth -= 1

    # Outcome

    def commit(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """(tables, changes by table): triggers run, deletions act on children, and every constraint holds."""
        self._run_triggers()
        out = dict(self.committed)
        for table, keys in self.deletes.items():
            gone = out[table].join(keys, self._key(table), "left_semi")
            out = CO.delete_with_actions(out, self.catalog, table, gone)
        for table, rows in self.upserts.items():
            out[table] = CH.upsert(out[table], rows, self._key(table))
        touched = {t for t in out if out[t] is not self.committed[t]}
        for table in touched:
            CO.validate(out[table], self._spec(table), out)
        return out, {t: self._changes(t, out[t]) for t in touched}

    def _run_triggers(self) -> None:
        """Each trigger is told of the rows that came, changed (as they are now) and went (as they were), by its event; the rows it
        adds are writes like others, with triggers of their own."""
        fresh = [(t, event, rows) for t in self.upserts for event, rows in self._events(t, self.upserts[t], self.committed[t])]
        fresh += [(t, "delete", self.committed[t].join(keys, self._key(t), "left_semi")) for t, keys in self.deletes.items()]
        depth = 0
        while fresh := [(t, event, rows) for t, event, rows in fresh if t in self.triggers and not rows.isEmpty()]:
            if depth >= CO.DEPTH:
                raise EngineError(f"triggers nested deeper than {CO.DEPTH}")
            added: dict[str, DataFrame] = {}
            for table, event, rows in fresh:
                for trigger in self.triggers[table]:
                    for name, more in trigger(event, rows).items():
                        added[name] = more if name not in added else added[name].unionByName(more)
            fresh = [(t, event, rows) for t, more in added.items() for event, rows in self._events(t, more, self.scan(t))]
            for table, more in added.items():
                self._stage(table, more)
            depth += 1

    def _events(self, table: str, rows: DataFrame, old: DataFrame) -> list[tuple[str, DataFrame]]:
        keys, key = old.select(*self._key(table)), self._key(table)
        return [("insert", rows.join(keys, key, "left_anti")), ("update", rows.join(keys, key, "left_semi"))]

    def _changes(self, table: str, after: DataFrame) -> DataFrame:
        """(op, key, before, after) of the rows that differ."""
        key = self._key(table)
        old = self.committed[table].select(*key, F.struct("*").alias("before"))
        new = after.select(*key, F.struct("*").alias("after"))
        rows = old.join(new, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
        op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return rows.select(op.alias("op"), *key, "before", "after")


def view(function: Callable, catalog: Catalog, tables: dict[str, DataFrame], *args) -> DataFrame:
    """The rows of a view function: it reads by a transaction of its own, and may write nothing."""
    txn = Transaction(catalog, tables)
    rows = txn.call(function, *args)
    if txn.upserts or txn.deletes:
        raise EngineError("a view function wrote")
    return rows


def run(procedure: Callable, catalog: Catalog, tables: dict[str, DataFrame], *args, triggers: dict | None = None):
    """Run a procedure in a transaction of its own; its error leaves ``tables`` as they are."""
    txn = Transaction(catalog, tables, triggers)
    txn.call(procedure, *args)
    return txn.commit()
