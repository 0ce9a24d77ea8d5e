"""Logical types and how they live in Spark.

Unsigned integers take the next wider Spark type and a range check; ids of 64 bits stay ``long``. Text compares by
bytes, as Spark's default collation does. Times are UTC microseconds; a literal for one is an integer of microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.errors import TypeMismatch


@dataclass(frozen=True)
class LogicalType:
    name: str
    spark: str
    low: int | None = None
    high: int | None = None
    ordered: bool = True

    @property
    def integer(self) -> bool:
        return self.low is not None


def _int(name: str, spark: str, bits: int, signed: bool) -> LogicalType:
    return LogicalType(name, spark, -(1 << (bits - 1)) if signed else 0, (1 << (bits - signed)) - 1)


TYPES = {
    t.name: t
    for t in (
        LogicalType("bool", "boolean", ordered=False),
        _int("i8", "tinyint", 8, True),
        _int("i16", "smallint", 16, True),
        _int("i32", "int", 32, True),
        _int("i64", "bigint", 64, True),
        _int("u8", "smallint", 8, False),
        _int("u16", "int", 16, False),
        _int("u32", "bigint", 32, False),
        LogicalType("u64", "decimal(20,0)", 0, (1 << 64) - 1),
        LogicalType("id", "bigint", 0, (1 << 63) - 1),
        LogicalType("f32", "float"),
        LogicalType("f64", "double"),
        LogicalType("str", "string"),
        LogicalType("bytes", "binary", ordered=False),
        LogicalType("identity", "string", ordered=False),
        LogicalType("timestamp", "timestamp_ntz"),
        LogicalType("decimal", "decimal(38,6)"),
        LogicalType("blob", "binary", ordered=False),
        LogicalType("crdt_text", "binary", ordered=False),
    )
}


def literal(value, kind: LogicalType) -> Column:
    """A typed literal for a column of ``kind``; TypeMismatch if the type cannot hold the value."""
    wrong = TypeMismatch(f"{value!r} is no {kind.name}")
    is_int = isinstance(value, int) and not isinstance(value, bool)
    if kind.integer:
        if not is_int or not kind.low <= value <= kind.high:
            raise wrong
        return F.lit(Decimal(value)).cast(kind.spark) if kind.name == "u64" else F.lit(value).cast(kind.spark)
    if kind.name in ("f32", "f64"):
        if not (is_int or isinstance(value, float)):
            raise wrong
        return F.lit(float(value)).cast(kind.spark)
    if kind.name == "timestamp":
        if not is_int:
            raise wrong
        return F.timestamp_micros(F.lit(value)).cast("timestamp_ntz")
    if kind.name == "bool":
        if not isinstance(value, bool):
            raise wrong
        return F.lit(value)
    if kind.name in ("str", "identity"):
        if not isinstance(value, str):
            raise wrong
        return F.lit(value)
    raise wrong  # bytes, blobs, decimals and documents have no literal


def out_of_range(column: str, kind: LogicalType) -> Column:
    """Where a stored value does not fit the logical type."""
    if not kind.integer:
        return F.lit(False)
    return F.coalesce((F.col(column) < kind.low) | (F.col(column) > F.lit(Decimal(kind.high)).cast("decimal(20,0)")), F.lit(False))
