"""Collaborative text as a table of operations.

An insert puts one character after another (``parent``; null: at the start) under the id (seq, actor); a delete marks
an id. A document's text is the walk of that tree, later siblings first, without deleted characters: the same whatever
order the operations came in, and however often.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = "doc_id long, kind string, seq long, actor long, parent_seq long, parent_actor long, ch string"
#: Operations that a task folds, on average: more operations make more tasks.
TASK_OPS = 1 << 19


def walk(ops: Iterable[tuple]) -> str:
    """The text of one document's operations: (kind, seq, actor, parent_seq, parent_actor, ch)."""
    inserts, deleted = {}, set()
    for kind, seq, actor, p_seq, p_actor, ch in ops:
        parent = None if p_seq is None else (p_seq, p_actor)
        if kind == "insert":
            inserts[(seq, actor)] = (parent, ch)
        else:
            deleted.add(parent)
    below: dict = {}
    for i in sorted(inserts):
        below.setdefault(inserts[i][0], []).append(i)
    out, stack = [], list(below.get(None, ()))
    while stack:
        i = stack.pop()  # the latest sibling
        if i not in deleted:
            out.append(inserts[i][1])
        stack += below.get(i, ())
    return "".join(out)


def texts(ops: DataFrame) -> DataFrame:
    """(doc_id, text): documents are folded one at a time from batches sorted by document.

    Operations are dealt out by document to a number of tasks that follows their count. Left to Spark it would follow their
    compressed bytes, which are few, so that a task's memory grew with the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found: tuple[list, list] = ([], [])
        for i, part in groupby(rows, lambda row: row[0]):
            found[0].append(i)
            found[1].append(walk(row[1:] for row in part))
            if len(found[0]) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string())], ["doc_id", "text"])
                found = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string())], ["doc_id", "text"])

    tasks = max(1, -(-ops.count() // TASK_OPS))
    dealt = ops.repartition(tasks, "doc_id").dropDuplicates(["doc_id", "kind", "seq", "actor"])
    kept = dealt.select("doc_id", "kind", "seq", "actor", "parent_seq", "parent_actor", "ch")
    return kept.sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, text string")


def patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """Operations that ``new`` has and ``old`` lacks: what a reader of the old text is sent."""
    return new.join(old.select("doc_id", "kind", "seq", "actor"), ["doc_id", "kind", "seq", "actor"], "left_anti")


def typed(doc_id: int, text: str, actor: int = 1) -> list[tuple]:
    """Operations that type a text from its start."""
    return [(doc_id, "insert", k + 1, actor, k if k else None, actor if k else None, c) for k, c in enumerate(text)]


def next_seq(ops: DataFrame) -> DataFrame:
    return ops.groupBy("doc_id").agg((F.max("seq") + 1).alias("next_seq"))
