"""The closed read surface: one table, conjunctive predicates, whole rows, one order, keyset pages, points in time.

Requests are values, not text: what the surface leaves out (joins, OR, NOT, expressions, OFFSET) cannot be said. For
free SQL there is Spark's own. A request compiles to one DataFrame, so predicates reach the scan and a limited order
becomes a top-k.
"""

from __future__ import annotations

import hashlib
import io
import re
from contextlib import redirect_stdout
from dataclasses import dataclass
from dataclasses import field as _field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import LimitRejected, NoSpatialIndex, ScanBudgetExceeded, TypeMismatch, Unsupported
from rivulet.operators import fulltext, spatial
from rivulet.schema import Index, TableSpec
from rivulet.types import literal


@dataclass(frozen=True)
class Eq:
    column: str
    value: object


@dataclass(frozen=True)
class In:
    column: str
    values: tuple


@dataclass(frozen=True)
class Between:
    column: str
    low: object
    high: object


@dataclass(frozen=True)
class Cmp:
    column: str
    op: str  # < <= > >=
    value: object


@dataclass(frozen=True)
class Match:
    column: str
    query: str


@dataclass(frozen=True)
class Region:
    x: float
    y: float
    w: float
    h: float


@dataclass(frozen=True)
class Radius:
    r: float
    x: float
    y: float


@dataclass(frozen=True)
class Order:
    column: str  # or SCORE
    desc: bool = False


@dataclass(frozen=True)
class Select:
    table: str
    where: tuple = ()
    spatial: Region | Radius | None = None
    order: Order | None = None
    limit: int | None = None
    after: tuple | None = None  # (order value, key)
    as_of: tuple | None = None  # ("tx", n) or ("timestamp", microseconds)
    score: bool = False

    def normalized(self) -> str:
        """One text for equal requests; conditions keep their order."""
        parts = [f"SELECT *{', SCORE' if self.score else ''} FROM {self.table}"]
        if self.where:
            parts.append("WHERE " + " AND ".join(map(_condition_text, self.where)))
        if isinstance(self.spatial, Region):
            parts.append(f"IN REGION ({self.spatial.x}, {self.spatial.y}, {self.spatial.w}, {self.spatial.h})")
        if isinstance(self.spatial, Radius):
            parts.append(f"WITHIN RADIUS {self.spatial.r} OF ({self.spatial.x}, {self.spatial.y})")
        if self.order:
            parts.append(f"ORDER BY {self.order.column} {'DESC' if self.order.desc else 'ASC'}")
        if self.limit is not None:
            parts.append(f"LIMIT {self.limit}")
        if self.after:
            parts.append(f"AFTER ({_value(self.after[0])}, {_value(self.after[1])})")
        if self.as_of:
            parts.append(f"AS OF {self.as_of[0].upper()} {self.as_of[1]}")
        return " ".join(parts)

    def query_hash(self, viewer: str = "") -> str:
        """Names the plan that equal requests share; ``viewer`` folds in whoever it is scoped to."""
        return hashlib.sha256(f"{self.normalized()}\0{viewer}".encode()).hexdigest()[:16]


def _value(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)


def _condition_text(c) -> str:
    match c:
        case Eq():
            return f"{c.column} = {_value(c.value)}"
        case In():
            return f"{c.column} IN ({', '.join(map(_value, c.values))})"
        case Between():
            return f"{c.column} BETWEEN {_value(c.low)} AND {_value(c.high)}"
        case Cmp():
            return f"{c.column} {c.op} {_value(c.value)}"
        case Match():
            return f"{c.column} MATCH {_value(c.query)}"
    raise Unsupported(f"condition {c!r}")


@dataclass(frozen=True)
class Bounds:
    """What a server may hold its readers to; an excess is an error or a clamp, never a silent cut of the scan."""

    default_limit: int | None = None
    max_limit: int | None = None
    reject: bool = False
    scan_budget: int | None = None

    def limit(self, asked: int | None) -> int | None:
        asked = self.default_limit if asked is None else asked
        if self.max_limit is not None and (asked is None or asked > self.max_limit):
            if self.reject and asked is not None:
                raise LimitRejected(f"limit {asked} is above {self.max_limit}")
            return self.max_limit
        return asked


@dataclass
class Compiled:
    """A request's predicate and order over its table, with nothing executed."""

    select: Select
    spec: TableSpec
    predicate: Column
    score: tuple[str, str, fulltext.Analyzer] | None = None  # column, query, analyzer
    order: list[Column] = _field(default_factory=list)
    limit: int | None = None
    match: tuple[str, str, fulltext.Analyzer] | None = None  # the same, of a match without a score too
    rest: Column | None = None  # the predicate without the match

    def apply(self, df: DataFrame, bounds: Bounds = Bounds(), index: fulltext.StoredIndex | None = None) -> DataFrame:
        """The rows of ``df``; a match is answered from a stored index of the whole table, if there is one."""
        if bounds.scan_budget is not None and df.limit(bounds.scan_budget + 1).count() > bounds.scan_budget:
            raise ScanBudgetExceeded(f"more than {bounds.scan_budget} rows")
        # Scores are over the whole table, whatever the other conditions are.
        if index is not None and self.match:
            key = self.spec.primary_key[0]
            found = index.scores(key, *self.match[1:])
            out = df.where(self.rest).join(found, key).select(*df.columns, "_score")
            out = out if self.score else out.drop("_score")
        else:
            out = fulltext.with_score(df, *self.score) if self.score else df
            out = out.where(self.predicate)
        if self.order:
            out = out.orderBy(*self.order)
        limit = bounds.limit(self.limit)
        out = out if limit is None else out.limit(limit)
        return out if self.select.score or not self.score else out.drop("_score")

    def explain(self, df: DataFrame) -> dict:
        """The request in its parts and Spark's plan for it over ``df``: ``access`` is what reaches the scans, ``residual``
        what is judged row by row after them."""
        with redirect_stdout(io.StringIO()) as out:
            self.apply(df).explain("formatted")
        plan = out.getvalue()
        return {
            "table": self.spec.name,
            "normalized": self.select.normalized(),
            "access": re.findall(r"PushedFilters: \[(.*)\]", plan),
            "residual": re.findall(r"Condition : (.*)", plan),
            "order": self.select.order and f"{self.select.order.column} {'desc' if self.select.order.desc else 'asc'}",
            "limit": self.select.limit,
            "cursor": self.select.after,
            "plan": plan,
        }


_OPS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def condition(c, spec: TableSpec) -> Column:
    """One predicate over typed literals. NaN equals and exceeds nothing; null matches nothing."""
    column = spec.column(c.column)
    col, kind = F.col(c.column), column.kind
    real = ~F.isnan(col) if kind.name in ("f32", "f64") else F.lit(True)
    if isinstance(c, (Between, Cmp)) and (not kind.ordered or column.nullable):
        raise TypeMismatch(f"{c.column} has no order to compare by")
    match c:
        case Eq():
            return (col == literal(c.value, kind)) & real
        case In():
            if not c.values:
                raise Unsupported("an empty IN")
            return col.isin(*(literal(v, kind) for v in c.values)) & real
        case Between():
            return col.between(literal(c.low, kind), literal(c.high, kind)) & real
        case Cmp():
            if c.op not in _OPS:
                raise Unsupported(f"operator {c.op}")
            return getattr(col, _OPS[c.op])(literal(c.value, kind)) & real
    raise Unsupported(f"condition {c!r}")


def spatial_condition(clause: Region | Radius, spec: TableSpec) -> Column:
    index = spec.index("quadtree", "rtree")
    if index is None:
        raise NoSpatialIndex(f"{spec.name} has no spatial index")
    columns = tuple(F.col(c).cast("double") for c in index.columns)
    if isinstance(clause, Region):
        bounds = (clause.x, clause.y, clause.w, clause.h)
        return spatial.point_in_region(*columns, *bounds) if index.kind == "quadtree" else spatial.box_meets_region(columns, *bounds)
    bounds = (clause.r, clause.x, clause.y)
    return spatial.point_in_radius(*columns, *bounds) if index.kind == "quadtree" else spatial.box_in_radius(columns, *bounds)


def compile_select(select: Select, spec: TableSpec) -> Compiled:
    """Check a request against its table; errors carry the codes of rivulet.errors."""
    plain = [c for c in select.where if not isinstance(c, Match)]
    found = [c for c in select.where if isinstance(c, Match)]
    conditions = [condition(c, spec) for c in plain]
    score = None
    if len(found) > 1:
        raise Unsupported("more than one MATCH")
    if found:
        index = next((i for i in spec.indexes if i.kind == "fulltext" and i.columns[0] == found[0].column), None)
        spec.column(found[0].column)
        if index is None:
            raise Unsupported(f"{found[0].column} has no full-text index")
        if select.spatial:
            raise Unsupported("MATCH with a spatial clause")
        analyzer = fulltext.Analyzer.of(index)
        score = (found[0].column, found[0].query, analyzer)
    if select.spatial:
        conditions.append(spatial_condition(select.spatial, spec))
    by_score = select.order is not None and select.order.column == "SCORE" and all(c.name != "SCORE" for c in spec.columns)
    if (select.score or by_score) and not found:
        raise Unsupported("SCORE without MATCH")
    order = []
    if by_score:
        order = [F.desc("_score") if select.order.desc else F.asc("_score"), *map(F.asc, spec.primary_key)]
    elif select.order:
        name, desc = select.order.column, select.order.desc
        spec.column(name)
        order = [F.desc_nulls_last(name) if desc else F.asc_nulls_first(name), *(map(F.desc if desc else F.asc, spec.primary_key))]
    if select.after:
        conditions.append(_after(select, spec))
    match, rest = score, reduce(and_, conditions, F.lit(True))
    predicate = rest if match is None else rest & fulltext.matches(F.col(match[0]), *match[1:])
    return Compiled(select, spec, predicate, score if select.score or by_score else None, order, select.limit, match, rest)


def _after(select: Select, spec: TableSpec) -> Column:
    if select.order is None or len(spec.primary_key) != 1:
        raise Unsupported("AFTER needs an order and a single key")
    name, key = select.order.column, spec.primary_key[0]
    if not (name == key or any(i.kind == "btree" and name in i.columns for i in spec.indexes)):
        raise Unsupported("AFTER needs an order that an index serves")
    value, last = literal(select.after[0], spec.column(name).kind), literal(select.after[1], spec.column(key).kind)
    v, k = F.col(name), F.col(key)
    if select.order.desc:
        return (v <= value) & ((v < value) | (k < last))
    return (v >= value) & ((v > value) | (k > last))


def lookup(df: DataFrame, spec: TableSpec, key: tuple) -> DataFrame:
    """The row with a primary key."""
    return df.where(reduce(and_, (condition(Eq(c, v), spec) for c, v in zip(spec.primary_key, key, strict=True)))).limit(1)


def index_layout(df: DataFrame, index: Index) -> DataFrame:
    """Rows clustered as a btree index would hold them, so that row-group statistics prune by it."""
    return df.repartitionByRange(*index.columns).sortWithinPartitions(*index.columns)
