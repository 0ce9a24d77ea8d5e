"""Shared pieces of the corpus operators: Arrow limits, groups of sorted batches and word arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rivulet.sources.shared import BATCH_BYTES, bound_batches, materialize, shared_dir, write_once

__all__ = ["BATCH_BYTES", "arrow_map", "binaries", "materialize", "shared_dir", "sorted_groups", "words_of", "write_once"]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batch bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` of a partition that is sorted by them, as one table per group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        edges = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space words of each text: offsets (one more than texts), index of each word, distinct words."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    if "" in names:
        full = index != names.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        index = index[full]
    return offsets, index, names


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
