"""Declared tables: columns, keys, indexes, visibility, constraints; validation, and what may change between versions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import EngineError, UnknownColumn, UnknownTable
from rivulet.types import TYPES, LogicalType


class SchemaError(EngineError):
    """A declaration that contradicts itself."""

    code = 1000


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False
    computed: str | None = None  # SQL expression over the columns before it
    check: str | None = None  # SQL condition
    mask: str | None = None  # null, redact, hash or ciphertext
    grant: str = "public"  # public, owner, server_peer or role:<name>
    normalize: tuple = ()  # ("string", form, case, trim) or ("money", scale)
    encrypted: bool = False
    signed: bool = False
    default: object = None
    renamed_from: str | None = None

    @property
    def kind(self) -> LogicalType:
        return TYPES[self.type]


@dataclass(frozen=True)
class Index:
    kind: str  # btree, quadtree (x, y), rtree (min_x, min_y, max_x, max_y) or fulltext (column)
    columns: tuple[str, ...]
    language: str = "simple"
    stop_words: bool = False
    stemming: bool = False


@dataclass(frozen=True)
class Visibility:
    rule: str = "public_all"  # public_all, owner_only or member_of
    column: str | None = None  # the owner, or the key that membership gives
    table: str | None = None  # membership table
    member: str | None = None  # its column that names the viewer
    key: str | None = None  # its column that names the key


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    references: str
    on_delete: str = "restrict"  # restrict, cascade or set_null


@dataclass(frozen=True)
class Ttl:
    column: str | None = None  # expires when its time has come, or
    after_us: int | None = None  # so long after the last write


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    access: str = "public"  # public, private, global or ephemeral
    auto_inc: bool = False
    partition_by: str | None = None
    owner: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[Index, ...] = ()
    visibility: Visibility = field(default_factory=Visibility)
    foreign_keys: tuple[ForeignKey, ...] = ()
    ttl: Ttl | None = None

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise UnknownColumn(f"{self.name} has no column {name}")

    def index(self, *kinds: str) -> Index | None:
        return next((i for i in self.indexes if i.kind in kinds), None)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c.name}` {c.kind.spark}" + ("" if c.nullable else " not null") for c in self.columns))

    def validate(self) -> TableSpec:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise SchemaError(f"{self.name}: {what}")

        names = [c.name for c in self.columns]
        need(bool(names), "has no columns")
        need(len(set(names)) == len(names), "repeats a column")
        need(all(c.type in TYPES for c in self.columns), "has an unknown type")
        need(bool(self.primary_key) and len(set(self.primary_key)) == len(self.primary_key), "needs a primary key of distinct columns")
        used = [*self.primary_key, *(x for u in self.unique for x in u), *(x for i in self.indexes for x in i.columns), *(f.column for f in self.foreign_keys)]
        for name in used:
            self.column(name)
        need(all(self.unique), "has an empty unique set")
        need(not self.auto_inc or (len(self.primary_key) == 1 and self.column(self.primary_key[0]).type in ("id", "u64")), "auto-increment needs one unsigned 64-bit key")
        need(not (self.partition_by and self.access == "global"), "a global table has no partitions")
        need(self.access in ("public", "private", "global", "ephemeral"), "has an unknown access class")
        spatial = [i for i in self.indexes if i.kind in ("quadtree", "rtree")]
        need(len({i.kind for i in spatial}) < 2, "mixes two kinds of spatial index")
        for i in self.indexes:
            arity = {"quadtree": 2, "rtree": 4, "fulltext": 1}.get(i.kind)
            need(i.kind == "btree" or arity == len(i.columns), f"index {i.kind} takes {arity} columns")
            need(i.kind not in ("quadtree", "rtree") or all(self.column(c).type in ("f32", "f64") for c in i.columns), "a spatial index takes floats")
            need(i.kind != "fulltext" or self.column(i.columns[0]).type == "str", "a full-text index takes text")
        need(self.visibility.rule in ("public_all", "owner_only", "member_of"), f"visibility {self.visibility.rule} is refused")
        if self.visibility.rule != "public_all":
            self.column(self.visibility.column)
        for c in self.columns:
            need(c.mask in (None, "null", "redact", "hash", "ciphertext"), f"mask {c.mask} is unknown")
            need(c.mask != "hash" or c.type in ("str", "bytes"), "a hash mask takes text or bytes")
            need(c.mask != "ciphertext" or c.encrypted, "a ciphertext mask takes an encrypted column")
        return self


class Catalog:
    """The tables of a database, by name."""

    def __init__(self, *specs: TableSpec):
        self.tables = {s.name: s.validate() for s in specs}
        for s in specs:
            for f in s.foreign_keys:
                self.table(f.table).column(f.references)

    def table(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise UnknownTable(f"no table {name}")
        return self.tables[name]


@dataclass(frozen=True)
class Change:
    kind: str
    column: str | None = None
    allowed: bool = False


def diff(old: TableSpec, new: TableSpec) -> list[Change]:
    """What changes from one declaration to the next, and whether it applies by itself."""
    out = []
    have = {c.name: c for c in old.columns}
    renamed = {c.renamed_from: c.name for c in new.columns if c.renamed_from in have and c.name not in have}
    kept = [renamed.get(c.name, c.name) for c in old.columns]
    names = [c.name for c in new.columns]
    for c in old.columns:
        name = renamed.get(c.name, c.name)
        if name not in names:
            out.append(Change("remove_column", c.name))
        else:
            if c.name in renamed:
                out.append(Change("rename_column", name, True))
            if new.column(name).type != c.type:
                out.append(Change("change_type", name))
    common = [n for n in kept if n in names]
    if [n for n in names if n in common] != common:
        out.append(Change("reorder_columns"))
    for k, c in enumerate(new.columns):
        if c.name not in kept:
            has_default = c.nullable or c.default is not None
            last = all(n not in kept for n in names[k:])
            out.append(Change("add_column" if has_default else "add_column_without_default", c.name, has_default and last))
    if tuple(renamed.get(k, k) for k in old.primary_key) != new.primary_key:
        out.append(Change("change_primary_key"))
    return out


def migrate(df: DataFrame, old: TableSpec, new: TableSpec) -> DataFrame:
    """The stored rows in the new shape; SchemaError if a change needs a person to decide."""
    refused = [c for c in diff(old, new) if not c.allowed]
    if refused:
        raise SchemaError(f"{new.name}: {', '.join(f'{c.kind} {c.column or ''}'.strip() for c in refused)}")
    have = {c.name for c in old.columns}
    columns = []
    for c in new.columns:
        source = c.name if c.name in have else c.renamed_from if c.renamed_from in have else None
        columns.append((F.col(source) if source else F.lit(c.default).cast(c.kind.spark)).alias(c.name))
    return df.select(*columns)


def with_columns(spec: TableSpec, **changes) -> TableSpec:
    return replace(spec, **changes)
