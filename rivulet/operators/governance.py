"""Who sees which rows and which columns. Rows are filtered on stored values first; columns are masked last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.schema import Column as ColumnSpec
from rivulet.schema import TableSpec


@dataclass(frozen=True)
class Viewer:
    identity: str
    roles: frozenset[str] = frozenset()
    is_peer: bool = False

    def scope(self, spec: TableSpec) -> str:
        """What tells this viewer's results apart from others' of the same query: nothing, or identity and roles."""
        if self.is_peer:
            return "peer"
        scoped = spec.visibility.rule != "public_all" or any(c.grant != "public" or c.mask for c in spec.columns)
        return f"{self.identity}|{','.join(sorted(self.roles))}" if scoped else ""


def visible_rows(df: DataFrame, spec: TableSpec, viewer: Viewer, membership: DataFrame | None = None) -> DataFrame:
    """Rows that the viewer may see. Membership is a semi-join on the keys of the viewer's own membership rows."""
    rule = spec.visibility
    if viewer.is_peer or rule.rule == "public_all":
        return df
    if rule.rule == "owner_only":
        return df.where(F.col(rule.column) == viewer.identity)
    keys = membership.where(F.col(rule.member).cast("string") == viewer.identity).select(F.col(rule.key).alias(rule.column)).distinct()
    return df.join(keys, rule.column, "left_semi")


def _authorized(column: ColumnSpec, spec: TableSpec, viewer: Viewer) -> Column:
    if viewer.is_peer or column.grant == "public":
        return F.lit(True)
    if column.grant == "owner":
        owner = spec.owner or spec.visibility.column
        return F.coalesce(F.col(owner).cast("string") == viewer.identity, F.lit(False))
    return F.lit(column.grant.startswith("role:") and column.grant[5:] in viewer.roles)


_ZERO = {"bool": False, "str": "", "identity": "", "bytes": b"", "blob": b"", "crdt_text": b""}


def masked(column: ColumnSpec) -> Column:
    """What stands in for a value: null (the type's zero where null may not be), its zero, its hash or its ciphertext."""
    kind = column.kind
    zero = F.timestamp_micros(F.lit(0)) if kind.name == "timestamp" else F.lit(_ZERO.get(kind.name, 0))
    zero = zero.cast(kind.spark)
    if column.mask == "hash":
        return F.sha2(F.col(column.name), 256)
    if column.mask == "ciphertext":
        return F.lower(F.hex(column.name)) if kind.name == "str" else F.col(column.name)
    if column.mask == "null" and column.nullable:
        return F.lit(None).cast(kind.spark)
    return zero


def project(df: DataFrame, spec: TableSpec, viewer: Viewer, key: str | None = None) -> DataFrame:
    """Columns as the viewer may see them: decrypted where granted, masked where not; ``<column>_verified`` for signed ones."""
    out = []
    for c in spec.columns:
        col = F.col(c.name)
        shown = open_sealed(col, key, spec.name) if c.encrypted and key else col
        if c.mask is None and c.grant == "public":
            out.append(shown.alias(c.name))
            continue
        out.append(F.when(_authorized(c, spec, viewer), shown).otherwise(masked(c)).alias(c.name))
    if key:
        out += [verify(F.col(c.name), F.col(f"{c.name}_signature"), key).alias(f"{c.name}_verified") for c in spec.columns if c.signed]
    return df.select(*out)


def govern(df: DataFrame, spec: TableSpec, viewer: Viewer, membership: DataFrame | None = None, key: str | None = None) -> DataFrame:
    return project(visible_rows(df, spec, viewer, membership), spec, viewer, key)


def seal(value: Column, key: str, context: str) -> Column:
    """AES-GCM with a fresh nonce, bound to a table by its name as additional data."""
    return F.aes_encrypt(value, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(context))


def open_sealed(value: Column, key: str, context: str) -> Column:
    """Null where the value was not sealed with this key and context."""
    return F.try_aes_decrypt(value, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(context)).cast("string")


def sign(value: Column, key: str) -> Column:
    """HMAC-SHA-256 of a text, in lower-case hex."""
    block = bytes.fromhex(key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def verify(value: Column, signature: Column, key: str) -> Column:
    return F.coalesce(sign(value, key) == signature, F.lit(False))
