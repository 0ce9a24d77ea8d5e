"""Change logs and what is read from them.

A change row is (tx_id, ts, op, key..., before, after) with op insert, update or delete; ``before`` and ``after`` are
structs of the whole row, so that deletes match by what was there. A table is what its log folds to. Changes of one
transaction are in the order of ``seq``, if the log has that column; a log without it has one change a key and transaction.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.errors import OutOfWindow, UniqueViolation
from rivulet.operators.order import numbered


def _latest(log: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last change of each key: a max over a struct, which combines before the shuffle however hot a key is."""
    rest = [c for c in log.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return log.groupBy(*key).agg(row).select(*key, "row.*")


def _when(log: DataFrame) -> Column:
    return F.struct("tx_id", "seq") if "seq" in log.columns else F.struct("tx_id")


def as_of(log: DataFrame, key: list[str], tx: int | None = None, ts=None, oldest_tx: int | None = None) -> DataFrame:
    """The rows of a table at a point in its log; newer than the newest gives the live table."""
    if oldest_tx is not None and tx is not None and tx < oldest_tx:
        raise OutOfWindow(f"transaction {tx} is before {oldest_tx}, the oldest retained")
    seen = log
    if tx is not None:
        seen = seen.where(F.col("tx_id") <= tx)
    if ts is not None:
        seen = seen.where(F.col("ts") <= ts)
    return _latest(seen, key, _when(seen)).where("op != 'delete'").select("after.*")


def replay(log: DataFrame, key: list[str]) -> DataFrame:
    return as_of(log, key)


def retained(log: DataFrame, commits: int = 64) -> DataFrame:
    """Changes of the newest commits."""
    newest = log.select("tx_id").distinct().orderBy(F.desc("tx_id")).limit(commits).agg(F.min("tx_id").alias("oldest"))
    return log.join(F.broadcast(newest), F.col("tx_id") >= F.col("oldest")).drop("oldest")


def audit(log: DataFrame, key: str | None = None, value=None, tx: tuple[int, int] | None = None, limit: int = 1000) -> DataFrame:
    """Who touched what: (tx_id, ts, caller, inserted, deleted), without contents."""
    rows = log if key is None else log.where(F.col(key) == value)
    rows = rows if tx is None else rows.where(F.col("tx_id").between(*tx))
    count = lambda *ops: F.sum(F.col("op").isin(*ops).cast("long"))
    caller = F.min("caller").alias("caller") if "caller" in log.columns else F.lit(None).cast("string").alias("caller")
    return (
        rows.groupBy("tx_id").agg(F.min("ts").alias("ts"), caller, count("insert", "update").alias("inserted"), count("delete", "update").alias("deleted")).orderBy("tx_id").limit(limit)
    )


def cdc(log: DataFrame, key: list[str], after_tx: int = -1) -> DataFrame:
    """For a stream of changes: whole rows of what came, keys alone of what went."""
    rows = log.where(F.col("tx_id") > after_tx)
    return rows.select("tx_id", "op", *key, F.when(F.col("op") != "delete", F.col("after")).alias("row"))


# Writes


def conflicts(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(base.select(*key), key, "left_semi")


def insert(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    if not conflicts(base, rows, key).isEmpty() or not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise UniqueViolation(f"a row with this {', '.join(key)} is there")
    return base.unionByName(rows)


def upsert(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return base.join(rows.select(*key), key, "left_anti").unionByName(rows)


def effective(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Upserted rows that differ from what is there."""
    rest = [c for c in rows.columns if c not in key]
    old = base.select(*key, F.struct(*rest).alias("_old"))
    return rows.join(old, key, "left").where(~F.col("_old").eqNullSafe(F.struct(*rest))).select(*rows.columns)


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key), key, "left_anti")


def delete_where(base: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true stay, those where it is null as well."""
    return base.where(~F.coalesce(predicate, F.lit(False)))


def overlay(base: DataFrame, upserts: DataFrame, deletes: DataFrame, key: list[str]) -> DataFrame:
    """What a transaction sees: the committed rows under its own writes."""
    touched = upserts.select(*key).unionByName(deletes.select(*key)).distinct()
    return base.join(touched, key, "left_anti").unionByName(upserts)


def auto_increment(rows: DataFrame, column: str, last: int, order: list[str]) -> DataFrame:
    """Zero and null become the next number after ``last`` and all explicit ones."""
    given = F.coalesce(F.col(column), F.lit(0)) != 0
    top = rows.agg(F.greatest(F.lit(last).cast("long"), F.coalesce(F.max(column), F.lit(0))).alias("_top"))  # one row
    fresh = numbered(rows.where(~given), order, "_n").crossJoin(F.broadcast(top))
    fresh = fresh.withColumn(column, F.col("_top") + F.col("_n")).select(*rows.columns)
    return fresh.unionByName(rows.where(given))


def net_changes(log: DataFrame, key: list[str]) -> DataFrame:
    """One change for each key of a batch; what ends as it began is nothing."""
    ends = log.groupBy(*key).agg(
        F.min_by(F.struct("op", "before"), _when(log)).alias("first"), F.max_by(F.struct("op", "after"), _when(log)).alias("last"), F.max("tx_id").alias("tx_id")
    )
    before = F.when(F.col("first.op") != "insert", F.col("first.before"))
    after = F.when(F.col("last.op") != "delete", F.col("last.after"))
    out = ends.select("tx_id", *key, before.alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return out.withColumn("op", op)


# Live reads


def deltas(log: DataFrame, predicate, key: list[str]) -> DataFrame:
    """What a subscription is told: (tx_id, op, key, row). Deletes match by the row before; an update that leaves the
    predicate is a delete alone, one that enters it an insert alone. ``predicate`` builds a Column over a struct."""
    was = F.col("before").isNotNull() & F.coalesce(predicate(F.col("before")), F.lit(False))
    now = F.col("after").isNotNull() & F.coalesce(predicate(F.col("after")), F.lit(False))
    rows = log.withColumns({"_was": was, "_now": now}).where("_was or _now").where(~(F.col("_was") & F.col("_now") & F.col("before").eqNullSafe(F.col("after"))))
    # An update within the predicate goes out as its new row alone: a row of the log says so by itself.
    same = reduce(and_, (F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}")) for k in key))
    gone = rows.where(F.col("_was") & ~(F.col("_now") & same)).select("tx_id", F.lit("delete").alias("op"), *(F.col(f"before.{k}").alias(k) for k in key), F.lit(None).cast(log.schema["after"].dataType).alias("row"))
    come = rows.where("_now").select("tx_id", F.lit("insert").alias("op"), *(F.col(f"after.{k}").alias(k) for k in key), F.col("after").alias("row"))
    return gone.unionByName(come)


def masked_changes(log: DataFrame, visible: list[str]) -> DataFrame:
    """Updates whose visible columns did not change are dropped."""
    same = reduce(and_, (F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in visible))
    return log.where(~((F.col("op") == "update") & F.coalesce(same, F.lit(False))))


def stab(rows: DataFrame, column: str, constants: DataFrame) -> DataFrame:
    """Subscriptions touched by a batch: its values joined to the constants (query_id, value) of equality predicates."""
    return rows.join(constants, rows[column] == constants["value"])


def resume(delta_log: DataFrame, offset: int, window: int = 256) -> tuple[DataFrame, bool]:
    """Deltas after ``offset``, and whether the reader must start anew because they are no longer all there."""
    kept = delta_log.select("tx_id").distinct().orderBy(F.desc("tx_id")).limit(window).agg(F.min("tx_id").alias("oldest"), F.count(F.lit(1)).alias("n")).first()
    reset = kept["n"] == window and offset < kept["oldest"] - 1
    return delta_log.where(F.col("tx_id") > offset), reset


def refcounts(results: DataFrame, key: list[str]) -> DataFrame:
    """How many queries hold each row of a client's cache; results are (query_id, row columns)."""
    return results.groupBy(*key).agg(F.countDistinct("query_id").alias("refs"))


def reconcile(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Net events between two snapshots."""
    return old.exceptAll(fresh).withColumn("op", F.lit("delete")).unionByName(fresh.exceptAll(old).withColumn("op", F.lit("insert")))


class Optimistic:
    """A client's view of a table: what the server confirmed, under the layers of calls that it has not answered yet."""

    def __init__(self, confirmed: DataFrame, key: list[str]):
        self.confirmed, self.key = confirmed, key
        self.layers: dict[str, tuple[DataFrame, DataFrame]] = {}  # in the order of the calls

    def apply(self, call: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        none = self.confirmed.limit(0)
        self.layers[call] = (none if upserts is None else upserts, (none if deletes is None else deletes).select(*self.key))

    def rows(self) -> DataFrame:
        out = self.confirmed
        for upserts, deletes in self.layers.values():
            out = overlay(out, upserts, deletes, self.key)
        return out

    def confirm(self, call: str, confirmed: DataFrame) -> None:
        """The server's rows take the place of the call's layer; later layers stay on top."""
        self.layers.pop(call, None)
        self.confirmed = confirmed

    def rollback(self, call: str) -> None:
        self.layers.pop(call, None)


# Time


def expired(df: DataFrame, column: str, now: Column) -> DataFrame:
    return df.where(F.col(column) <= now)


def idle(log: DataFrame, key: list[str], now: Column, after_us: int) -> DataFrame:
    """Keys whose last write is longer ago than ``after_us``; deleted ones are gone already."""
    last = _latest(log, key, _when(log)).where("op != 'delete'")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return last.where(age > after_us).select(*key, F.col("ts").alias("last_write"))


def due(schedule: DataFrame, now_us: int) -> DataFrame:
    """Schedule rows to run, with their next time: one period on, or a period from now if that has passed; null: once."""
    step = F.col("execute_at_us") + F.col("period_us")
    following = F.when(F.col("period_us") > 0, F.when(step <= now_us, F.lit(now_us) + F.col("period_us")).otherwise(step))
    return schedule.where(F.col("execute_at_us") <= now_us).withColumn("next_us", following)


def first_submissions(calls: DataFrame, key: list[str], order: str, history: DataFrame | None = None) -> DataFrame:
    """The first call of each key that is not in the history."""
    new = calls if history is None else calls.join(history.select(*key).distinct(), key, "left_anti")
    rest = [c for c in calls.columns if c not in key]
    return new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*key, "row.*").select(*calls.columns)


def token_bucket(calls: DataFrame, who: str, at_us: str, capacity: int, per_second: float) -> DataFrame:
    """Admission by a token bucket for each caller, as ``admitted``, in order of time.

    Refusals depend on earlier refusals, so callers are folded in sorted batches, state carried from row to row.
    """
    import pyarrow as pa

    def run(batches):
        now, tokens, last = object(), 0.0, 0
        for batch in batches:
            out = []
            for w, t in zip(batch.column(who).to_pylist(), batch.column(at_us).to_pylist()):
                if w != now:
                    now, tokens, last = w, float(capacity), t
                tokens, last = min(capacity, tokens + (t - last) * per_second / 1e6), t
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "admitted"])

    ordered = calls.repartition(who).sortWithinPartitions(who, at_us)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    return ordered.mapInArrow(run, f"{fields}, admitted boolean")
