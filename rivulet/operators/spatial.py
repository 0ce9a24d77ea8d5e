"""Spatial predicates over constant regions, and grid cells. Bounds are closed; NaN coordinates match nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.errors import Malformed


def _finite(*values: float) -> None:
    if not all(math.isfinite(v) for v in values):
        raise Malformed("a spatial bound must be finite")


def _real(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & ~F.isnan(c)
    return out


def point_in_region(x: Column, y: Column, rx: float, ry: float, w: float, h: float) -> Column:
    """A negative extent is an empty region."""
    _finite(rx, ry, w, h)
    return x.between(rx, rx + w) & y.between(ry, ry + h) & _real(x, y) & F.lit(w >= 0 and h >= 0)


def point_in_radius(x: Column, y: Column, r: float, cx: float, cy: float) -> Column:
    """The bounding box comes first, as it reaches the scan."""
    _finite(r, cx, cy)
    if r < 0:
        raise Malformed("a radius must not be negative")
    dx, dy = x - cx, y - cy
    return x.between(cx - r, cx + r) & y.between(cy - r, cy + r) & (dx * dx + dy * dy <= r * r)


def point_at(x: Column, y: Column, px: float, py: float) -> Column:
    _finite(px, py)
    return (x == px) & (y == py) & _real(x, y)


def box_meets_region(box: tuple[Column, Column, Column, Column], rx: float, ry: float, w: float, h: float) -> Column:
    _finite(rx, ry, w, h)
    x0, y0, x1, y1 = box
    return (x0 <= rx + w) & (x1 >= rx) & (y0 <= ry + h) & (y1 >= ry) & _real(*box) & F.lit(w >= 0 and h >= 0)


def box_in_radius(box: tuple[Column, Column, Column, Column], r: float, cx: float, cy: float) -> Column:
    """By the least distance of the box."""
    _finite(r, cx, cy)
    if r < 0:
        raise Malformed("a radius must not be negative")
    x0, y0, x1, y1 = box
    dx = F.greatest(x0 - cx, F.lit(0.0), F.lit(cx) - x1)
    dy = F.greatest(y0 - cy, F.lit(0.0), F.lit(cy) - y1)
    return box_meets_region(box, cx - r, cy - r, 2 * r, 2 * r) & (dx * dx + dy * dy <= r * r)


def box_holds(box: tuple[Column, Column, Column, Column], px: float, py: float) -> Column:
    return box_meets_region(box, px, py, 0.0, 0.0)


def hash_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def placed_shard(partitioning: str | None, key: Column, shards: int) -> Column:
    """The shard of a table's rows: by hash of the key, or all on shard 0 if the table is global or not partitioned."""
    return hash_shard(key, shards) if partitioning == "hash" else F.lit(0)


def range_shard(key: Column, bounds: list) -> Column:
    """The greatest bound at or below the key; keys below the first go to it."""
    out = F.lit(0)
    for k, bound in enumerate(sorted(bounds)[1:], 1):
        out = F.when(key >= bound, F.lit(k)).otherwise(out)
    return out


def region_shard(x: Column, y: Column, size: float, columns: int, shards: int) -> Column:
    if size <= 0:
        raise Malformed("a region's size must be positive")
    columns, shards = max(1, columns), max(1, shards)
    cell = F.pmod(F.floor(y / size), F.lit(columns)) + F.pmod(F.floor(x / size), F.lit(columns)) * columns
    return F.pmod(cell, F.lit(shards)).cast("int")
