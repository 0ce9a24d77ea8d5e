"""Live queries on Structured Streaming.

A change stream has rows (tx_id, ts, op, before, after), as in rivulet.operators.changes. A router turns each
micro-batch into the deltas of every registered query and of every view, in one pass of ``foreachBatch``; the
checkpoint of the stream is what makes delivery at least once, and deltas carry their batch id so a repeated batch
overwrites itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import SubscriptionLimit, TableNotPublic, UnknownQueryId, UnknownTable
from rivulet.operators import changes as C
from rivulet.operators import views as V
from rivulet.operators.governance import Viewer, project, visible_rows
from rivulet.operators.select import Compiled, Eq, Select, compile_select
from rivulet.schema import Catalog
from rivulet.sources.shared import discard

PER_CONNECTION, PLANS = 1_000, 100_000


@dataclass
class Plan:
    """One query that all its subscribers share."""

    query_id: str
    compiled: Compiled
    viewer: Viewer
    connections: set[str] = field(default_factory=set)


class Subscriptions:
    """Who is subscribed to what; equal requests in an equal scope share a plan."""

    def __init__(self, catalog: Catalog, views: tuple[V.MatView, ...] = ()):
        self.catalog = catalog
        self.plans: dict[str, Plan] = {}
        self.views = {v.name: v for v in views}
        self.readers: dict[str, set[str]] = {}  # of views, by name

    def _admit(self, connection: str) -> None:
        held = sum(connection in p.connections for p in self.plans.values()) + sum(connection in r for r in self.readers.values())
        if held >= PER_CONNECTION:
            raise SubscriptionLimit(f"{connection} has {PER_CONNECTION} subscriptions")

    def add_view(self, connection: str, name: str) -> V.MatView:
        """Subscribe to a view by its name; its deltas are those that a router writes under that name."""
        if name not in self.views:
            raise UnknownTable(f"no view {name}")
        self._admit(connection)
        self.readers.setdefault(name, set()).add(connection)
        return self.views[name]

    def add(self, connection: str, select: Select, viewer: Viewer) -> str:
        spec = self.catalog.table(select.table)
        if spec.access != "public" and not viewer.is_peer:
            raise TableNotPublic(f"{spec.name} is {spec.access}")
        query_id = select.query_hash(viewer.scope(spec))
        self._admit(connection)
        if query_id not in self.plans:
            if len(self.plans) >= PLANS:
                raise SubscriptionLimit(f"{PLANS} plans are registered")
            self.plans[query_id] = Plan(query_id, compile_select(select, spec), viewer)
        self.plans[query_id].connections.add(connection)
        return query_id

    def remove(self, connection: str, query_id: str | None = None) -> None:
        """One subscription, or all of a connection; the last subscriber takes the plan along. A view goes by its name."""
        for name in [query_id] if query_id in self.readers else list(self.readers) if query_id is None else []:
            self.readers[name].discard(connection)
        if query_id in self.readers:
            return
        if query_id is not None and query_id not in self.plans:
            raise UnknownQueryId(query_id)
        for plan in [self.plans[query_id]] if query_id else list(self.plans.values()):
            plan.connections.discard(connection)
            if not plan.connections:
                del self.plans[plan.query_id]

    def initial(self, query_id: str, table: DataFrame, membership: DataFrame | None = None) -> DataFrame:
        plan = self.plans[query_id]
        rows = plan.compiled.apply(visible_rows(table, plan.compiled.spec, plan.viewer, membership))
        return project(rows, plan.compiled.spec, plan.viewer)

    def deltas(self, log: DataFrame, table: str, membership: DataFrame | None = None) -> DataFrame | None:
        """(query_id, tx_id, op, key..., row as JSON) of a batch for all queries on a table.

        Order and limit are not applied to deltas; predicates, spatial ones too, and row rules are. Membership is the
        one before the batch.
        """
        parts, pruned = [], defaultdict(list)
        for plan in self.plans.values():
            if plan.compiled.spec.name != table:
                continue
            constants = _constants(plan)
            if constants:
                pruned[tuple(constants)].append((plan.query_id, *constants.values()))
            elif plan.compiled.spec.visibility.rule == "member_of" and not plan.viewer.is_peer:
                parts.append(self._member_deltas(plan, log, membership))
            else:
                parts.append(self._plan_deltas(plan, log))
        parts += [self._pruned_deltas(self.catalog.table(table), log, columns, rows) for columns, rows in pruned.items()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _pruned_deltas(self, spec, log: DataFrame, columns: tuple[str, ...], rows: list[tuple]) -> DataFrame:
        """Deltas of all plans that ask for equality on the same columns: a batch meets their constants in a join, so the plan has
        one size for any number of them. A row whose columns stay as they are stays with its queries."""
        constants = log.sparkSession.createDataFrame(rows, "query_id string, " + ", ".join(f"`_{c}` {spec.column(c).kind.spark}" for c in columns))
        same = lambda names: reduce(and_, (F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in names))
        stays = F.col("before").isNotNull() & F.col("after").isNotNull() & same((*spec.primary_key, *columns))
        hit = lambda side: reduce(and_, (F.col(f"{side}.{c}") == F.col(f"_{c}") for c in columns))
        come = log.where(F.col("after").isNotNull()).join(constants, hit("after"))
        gone = log.where(F.col("before").isNotNull() & ~stays).join(constants, hit("before"))
        come = come.select("query_id", "tx_id", F.lit("insert").alias("op"), *(F.col(f"after.{k}").alias(k) for k in spec.primary_key), F.to_json(F.struct(*(f"after.{c.name}" for c in spec.columns))).alias("row"))
        gone = gone.select("query_id", "tx_id", F.lit("delete").alias("op"), *(F.col(f"before.{k}").alias(k) for k in spec.primary_key), F.lit(None).cast("string").alias("row"))
        return come.unionByName(gone)

    def _plan_deltas(self, plan: Plan, log: DataFrame) -> DataFrame:
        """One plan by its own predicate: a row of the log says by itself whether it was and is among the plan's rows."""
        spec, key = plan.compiled.spec, list(plan.compiled.spec.primary_key)
        rule, seen = spec.visibility, plan.compiled.predicate
        if rule.rule == "owner_only" and not plan.viewer.is_peer:
            seen = seen & (F.col(rule.column) == plan.viewer.identity)
        rows = log.select("tx_id", "before", "after")
        for side, flag in (("before", "_was"), ("after", "_now")):
            held = [c for c in rows.columns if c.startswith("_")]
            hit = F.col(side).isNotNull() & F.coalesce(seen, F.lit(False))
            rows = rows.select("tx_id", "before", "after", *held, f"{side}.*").select("tx_id", "before", "after", *held, hit.alias(flag))
        same = reduce(and_, (F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}")) for k in key))
        now = rows.where("_now").select(F.col("tx_id").alias("_tx"), "after.*")
        shown = project(now, _with(spec, "_tx"), plan.viewer)
        come = shown.select(F.col("_tx").alias("tx_id"), F.lit("insert").alias("op"), *key, F.to_json(F.struct(*[c.name for c in spec.columns])).alias("row"))
        gone = rows.where(F.col("_was") & ~(F.col("_now") & F.coalesce(same, F.lit(False))))
        gone = gone.select("tx_id", F.lit("delete").alias("op"), *(F.col(f"before.{k}").alias(k) for k in key), F.lit(None).cast("string").alias("row"))
        return come.unionByName(gone).select(F.lit(plan.query_id).alias("query_id"), "*")

    def _member_deltas(self, plan: Plan, log: DataFrame, membership: DataFrame | None) -> DataFrame:
        spec, key = plan.compiled.spec, list(plan.compiled.spec.primary_key)
        sides = {}
        for side in ("before", "after"):
            rows = log.where(F.col(side).isNotNull()).select("tx_id", f"{side}.*").where(plan.compiled.predicate)
            sides[side] = visible_rows(rows, spec, plan.viewer, membership)
        stays = sides["after"].select("tx_id", *key)
        shown = project(sides["after"].withColumnRenamed("tx_id", "_tx"), _with(spec, "_tx"), plan.viewer)
        come = shown.select(F.col("_tx").alias("tx_id"), F.lit("insert").alias("op"), *key, F.to_json(F.struct(*[c.name for c in spec.columns])).alias("row"))
        gone = sides["before"].join(stays, ["tx_id", *key], "left_anti")
        gone = gone.select("tx_id", F.lit("delete").alias("op"), *key, F.lit(None).cast("string").alias("row"))
        return come.unionByName(gone).select(F.lit(plan.query_id).alias("query_id"), "*")


def _constants(plan: Plan) -> dict:
    """Column -> value of a plan that is equalities alone over rows and columns that all its readers see alike, else nothing."""
    spec, select = plan.compiled.spec, plan.compiled.select
    rule = "public_all" if plan.viewer.is_peer else spec.visibility.rule
    plain = all(c.grant == "public" and not c.mask for c in spec.columns)
    if select.spatial or select.after or not plain or rule == "member_of" or not all(isinstance(c, Eq) for c in select.where):
        return {}
    asked = [(c.column, c.value) for c in select.where] + [(spec.visibility.column, plan.viewer.identity)] * (rule == "owner_only")
    found = dict(sorted(asked))
    exact = all(spec.column(c).kind.spark in ("bigint", "long", "int", "string", "boolean") and type(v) in (int, str, bool) for c, v in found.items())
    return found if exact and len(found) == len(asked) else {}


def _with(spec, name: str):
    from rivulet.schema import Column as ColumnSpec
    from rivulet.schema import with_columns

    return with_columns(spec, columns=(*spec.columns, ColumnSpec(name, "i64")))


class Router:
    """``foreachBatch`` target: writes deltas of subscriptions and views for each micro-batch.

    ``membership`` is a table, or a function of the batch's number that gives it, so changes of membership reach live queries
    with the next batch. Of a view's states the two newest are kept."""

    def __init__(self, subscriptions: Subscriptions, table: str, out: str, views: tuple[V.MatView, ...] = (), membership: DataFrame | Callable[[int], DataFrame] | None = None):
        self.subscriptions, self.table, self.out, self.views, self.membership = subscriptions, table, out.rstrip("/"), views, membership

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            membership = self.membership(batch_id) if callable(self.membership) else self.membership
            deltas = self.subscriptions.deltas(batch, self.table, membership)
            if deltas is not None:
                deltas.write.mode("overwrite").parquet(f"{self.out}/deltas/batch={batch_id}")
            for view in self.views:
                self._maintain(spark, view, batch, batch_id)
        finally:
            batch.unpersist()

    def _maintain(self, spark: SparkSession, view: V.MatView, batch: DataFrame, batch_id: int) -> None:
        """States are tables by batch: batch n reads n - 1, so doing it again gives the same."""
        side = lambda s: batch.where(F.col(s).isNotNull()).select(f"{s}.*")
        rows = V.signed(side("after"), side("before"))
        path = f"{self.out}/views/{view.name}/state/batch="
        old = spark.read.parquet(f"{path}{batch_id - 1}") if batch_id else None
        V.merge_state(view, old, rows).write.mode("overwrite").parquet(f"{path}{batch_id}")
        new = spark.read.parquet(f"{path}{batch_id}")
        after = V.read_state(view, new)
        before = V.read_state(view, old) if old is not None else after.where(F.lit(False))
        V.view_delta(view, before, after).write.mode("overwrite").parquet(f"{self.out}/views/{view.name}/deltas/batch={batch_id}")
        if batch_id > 1:
            discard(spark, f"{path}{batch_id - 2}")  # batch n is done again from n - 1 alone

    def view(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        view = next(v for v in self.views if v.name == name)
        return V.read_state(view, spark.read.parquet(f"{self.out}/views/{name}/state/batch={batch_id}"))


class CdcSink:
    """``foreachBatch`` target that hands on changes of chosen tables: whole rows, or keys of deleted ones.

    A log of several tables names a row's in the column ``table``; ``tables`` are those handed on (None: all)."""

    def __init__(self, key: list[str], out: str, tables: tuple[str, ...] | None = None):
        self.key, self.out, self.tables = key, out.rstrip("/"), tables

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.tables is not None:
            batch = batch.where(F.col("table").isin(*self.tables))
        keyed = batch.select("*", *(F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in self.key))
        rows = C.cdc(keyed, self.key)
        rows.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")


def first_calls(calls: DataFrame, key: list[str], at: str, keep: str = "1 hour") -> DataFrame:
    """Idempotent submissions: later calls with a key are dropped as long as the watermark keeps it."""
    return calls.withWatermark(at, keep).dropDuplicatesWithinWatermark(key)


def bucket_counts(events: DataFrame, at: str, by: str, interval: str, late: str) -> DataFrame:
    """Tumbling counts of an event stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, interval).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), by, "n")


def expiring(rows: DataFrame, column: str, now: Column) -> DataFrame:
    """Delete changes for rows whose time has come, for a trigger that ticks."""
    return C.expired(rows, column, now).withColumn("op", F.lit("delete"))
