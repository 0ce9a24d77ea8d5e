"""Value functions: normalizers, time buckets, deterministic numbers."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rivulet.sources.shared import bound_batches

#: Texts that Python holds at once as strings of its own.
SLICE = 64


def money(text: Column, scale: int) -> Column:
    """Exact decimal of a text: sign, digits, at most ``scale`` significant decimals; anything else is an error."""
    t = F.trim(text)
    ok = t.rlike(rf"^[+-]?(\d+(\.\d{{0,{scale}}}0*)?|\.\d{{1,{max(1, scale)}}}0*)$")
    value = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"\.$", "").cast(f"decimal(38,{scale})")
    return F.when(text.isNull(), None).when(ok, value).otherwise(F.raise_error(F.concat(F.lit("not an exact amount: "), t)).cast(f"decimal(38,{scale})"))


def is_money(text: Column, scale: int) -> Column:
    return F.trim(text).rlike(rf"^[+-]?(\d+(\.\d{{0,{scale}}}0*)?|\.\d{{1,{max(1, scale)}}}0*)$")


def money_from_minor_units(units: Column, scale: int) -> Column:
    return (units.cast("decimal(28,0)") / F.lit(10**scale).cast("decimal(28,0)")).cast(f"decimal(38,{scale})")


def normalize_string(text: Column, form: str | None = None, case: str | None = None, trim: bool = False) -> Column:
    """Trim and case in the JVM; Unicode forms, which Spark lacks, through an Arrow function.

    Texts that no form changes stay in the JVM: of ASCII alone, and for NFC of characters below U+0300 alone. The others go in
    batches of bounded bytes, of which Python holds a slice at a time as its own strings.
    """
    if form:
        bound_batches(SparkSession.active())
        plain = F.octet_length(text) == F.length(text)
        if form.lower() == "nfc":
            plain = plain | text.rlike(r"^[\x00-\u02FF]*$")

        @F.arrow_udf("string")
        def normal(texts: pa.Array) -> pa.Array:
            parts = [pa.array([], pa.string())]
            for k in range(0, len(texts), SLICE):
                some = texts.slice(k, SLICE).to_pylist()
                parts.append(pa.array([None if t is None else unicodedata.normalize(form.upper(), t) for t in some], pa.string()))
            return pa.concat_arrays(parts)

        text = F.when(plain, text).otherwise(normal(F.when(~plain, text)))
    text = F.lower(text) if case in ("lower", "fold") else text
    return F.trim(text) if trim else text


def time_bucket(us: Column, interval_us: int) -> Column:
    """Start of the bucket, also before the epoch."""
    return us - F.pmod(us, F.lit(interval_us))


def bucket_index(us: Column, interval_us: int) -> Column:
    return ((us - F.pmod(us, F.lit(interval_us))) / interval_us).cast("long")


def hash64(*columns: Column, seed: int = 0) -> Column:
    """A stable hash for plan sharing, shards and seeds; its values are Spark's own."""
    return F.xxhash64(F.lit(seed), *columns)


def random_u64(tx_id: Column, shard: Column, n: Column) -> Column:
    """The n-th number of a transaction: the same whenever it is run again."""
    return F.xxhash64(tx_id, shard, n, F.lit("rng"))


def random_below(tx_id: Column, shard: Column, n: Column, bound: int) -> Column:
    return F.pmod(random_u64(tx_id, shard, n), F.lit(bound))


def random_unit(tx_id: Column, shard: Column, n: Column) -> Column:
    """In [0, 1), from 53 bits."""
    return F.shiftrightunsigned(random_u64(tx_id, shard, n), 11) / F.lit(float(1 << 53))


def identity_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_json(columns: dict[str, str]) -> Column:
    """A row as JSON text: 64-bit ids, times and decimals as strings, bytes as lower-case hex."""
    out = []
    for name, kind in columns.items():
        c = F.col(name)
        if kind in ("id", "u64", "decimal"):
            c = c.cast("string")
        elif kind == "timestamp":
            c = F.unix_micros(c.cast("timestamp")).cast("string")
        elif kind in ("bytes", "blob", "crdt_text"):
            c = F.lower(F.hex(c))
        out.append(c.alias(name))
    return F.to_json(F.struct(*out), {"ignoreNullFields": "false"})
