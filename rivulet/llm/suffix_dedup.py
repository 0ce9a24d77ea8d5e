"""Removal of repeated byte strings by a blockwise suffix sort with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus (order: id, then place in
the document). That needs the corpus's suffixes in order as deep as ``LENGTH`` bytes, of those alone that may occur
twice. Steps:

1. Blocks: documents are range-partitioned and sorted by id and packed, with their order, into rows of a few megabytes.
2. Runs: a suffix's anchor is the (last) least hash among the ``WINDOW`` strings of ``GRAM`` bytes within its bytes. Equal suffixes have equal anchors, and neighbours mostly share theirs, so suffixes travel in runs of one anchor (28 on
   average, ``WINDOW`` at most) with the bytes of the run, some five bytes a suffix in place of a hundred. Anchors that
   occur once in the corpus are discarded, and their runs never leave their blocks.
3. Suffix buckets: runs are dealt into buckets of some ``BUCKET`` bytes by anchor, in ``PASSES`` groups of buckets, one
   after the other, each with its own shuffle whose files are dropped when it ends. A task sorts one bucket at a time, by
   bytes: cover samples of the bucket (residues of a perfect difference cover modulo ``V``) are ranked first by their
   ``DEPTH`` bytes; suffixes are then sorted by their first ``V`` bytes, and longer ties go by the ranks of the two samples
   at the shift that the cover has in common for both, and by the few bytes behind these. Of equal suffixes all but the
   earliest are reported to their blocks, as one mask a run.
4. Removal: reported suffixes mark their bytes; what remains of each document is put out with its numbers.

Hashes choose who meets, and bytes and ranks alone decide what is equal: a weak hash costs time, never a result.

Hot strings: a run that a block holds many times leaves it once. Anchors with more than ``HOT`` runs are taken apart: their
suffixes travel singly, by the hash of their whole ``LENGTH`` bytes and dealt over salts; each salt keeps its first of
each string, and only these meet. So no bucket grows with the number of copies or of contexts of a common string.

Defined cases: null text counts as empty; a null id sorts before all others; rows with equal ids keep some order, fixed
when blocks are written; documents shorter than ``LENGTH`` lose nothing; an empty table gives an empty table; other
columns are not read. A document lies in one block whole, as its checksum asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import arrow_map, materialize, sorted_groups

LENGTH, GRAM = 100, 44
WINDOW = LENGTH - GRAM + 1
#: Singer's perfect difference set of order 3: every difference modulo 13 but 0 occurs exactly once.
V, COVER = 13, (0, 1, 3, 9)
DEPTH = LENGTH - V + 1
BLOCK_BYTES, BUCKET, TASK_BYTES = 2 << 20, 1 << 20, 16 << 20
PASSES = 2
HOT, SALTS = 20_000, 64
_PIECE = 1 << 16
_LOW = np.uint64((1 << 17) - 1)  # holds any place in a piece
_BASE = 0x9E6C63D0876A9A47  # odd
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**k and _BASE**-k modulo 2**64."""
    out = np.full((2, n), _BASE, np.uint64)
    out[1] = pow(_BASE, -1, 1 << 64)
    out[:, 0] = 1
    return tuple(np.cumprod(out, axis=1))


def _hashes(piece: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each position that has so many: polynomials from prefix sums."""
    n = len(piece) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_PIECE + 2 * LENGTH)
    sums = np.empty(len(piece) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((piece + np.uint64(1)) * power[: len(piece)], out=sums[1:])
    x = _mixed((sums[size:] - sums[:n]) * inverse[:n])
    return x if bits == 64 else x << np.uint64(64 - bits)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads any others over all of them."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of the ``size`` values from each position on, by doubling."""
    n, have = len(x) - size + 1, 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[size - have : size - have + n])


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, ids, sizes: int64 each, data): documents in corpus order, whole, some ``block_bytes`` a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], "<i8")
            row = [pa.array([(part << 32) + block]), pa.array([ids], pa.list_(id_type)), pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "sizes", "data"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if texts and size + len(t) > block_bytes:
                    yield packed()
                    block += 1
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield packed()

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    # The place of a row in the input parts rows of one id, null or not.
    ordered = source.withColumn("at", F.spark_partition_id()).repartitionByRange("id", "at").sortWithinPartitions("id").select("id", "text")
    return materialize(arrow_map(ordered, run, f"block long, ids array<{kind}>, sizes binary, data binary"), "blocks")


def _edges(row_sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of a block's documents, and one more."""
    sizes = np.frombuffer(row_sizes, "<i8")
    return np.concatenate([[0], np.cumsum(sizes)]), sizes


def _starts(edges: np.ndarray) -> np.ndarray:
    """Whether ``LENGTH`` bytes of one document begin at each byte."""
    mark = np.zeros(edges[-1] + 1, np.int8)
    long = np.diff(edges) >= LENGTH
    mark[edges[:-1][long]] = 1
    mark[edges[1:][long] - LENGTH + 1] = -1
    return np.cumsum(mark[:-1], dtype=np.int8) > 0


def _runs(data: np.ndarray, edges: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, number of suffixes and anchor of each run of a block, in order; piece by piece.

    Of equal least hashes the last place is the anchor, so suffixes of one run have one anchor at different distances and
    are never equal: an anchor that occurs once has no repeats, in periodic bytes either.
    """
    inside = _starts(edges)
    out = []
    for a in range(0, len(data), _PIECE):
        piece = data[a : a + _PIECE + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        own = _hashes(piece, GRAM, bits)
        least = _least((own & ~_LOW) | (_LOW - np.arange(len(own), dtype=np.uint64)), WINDOW)
        valid = inside[a : a + len(least)]
        turn = np.ones(len(least) + 1, bool)
        turn[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        turn = np.flatnonzero(turn)
        place, size = turn[:-1], np.diff(turn)
        keep = valid[place]
        place, size = place[keep], size[keep]
        value = _mixed(own[(_LOW - (least[place] & _LOW)).astype(np.int64)])  # minima are small: all would fall into the first buckets
        out.append((place + a, size, value))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _bucket(hashes: np.ndarray, total: int) -> np.ndarray:
    return (((hashes >> np.uint64(40)) * np.uint64(total)) >> np.uint64(24)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys."""
    if not len(sorted_keys):
        return []
    edges = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512, weight: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded number and bytes."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= size or heavy > weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


_ANCHORS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("again", pa.binary()), ("anchors", pa.binary())])
_FLAGS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hot", pa.int64()), ("flags", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int64()), ("salt", pa.int64()), ("block", pa.int64()), ("heads", pa.binary()), ("text", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("told", pa.binary())])
_HEAD = np.dtype([("place", "<u4"), ("size", "u1"), ("shown", "u1")])  # shown: the run's bytes are in text
_MASK = np.dtype([("place", "<u4"), ("mask", "<u8")])  # bit k: the suffix at place + k is a repeat


def _emit_anchors(total: int, bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                values, count = np.unique(_runs(np.frombuffer(row["data"], np.uint8), _edges(row["sizes"])[0], bits)[2], return_counts=True)
                for a, b in _cuts(bucket := _bucket(values, total)):
                    yield int(bucket[a]), row["block"], np.packbits(count[a:b] > 1).tobytes(), values[a:b].tobytes()

    return lambda batches: _batches(rows(batches), _ANCHORS)


def _flag_anchors(hot: int):
    """For each block and bucket a number for each anchor sent: 0 alone, 1 occurs again, 2 hot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in sorted_groups(batches, ["bucket"]):
            parts = [np.frombuffer(x, np.uint64) for x in group["anchors"].to_pylist()]
            sizes = [len(p) for p in parts]
            again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group["again"].to_pylist(), sizes)])
            values = np.concatenate(parts)
            order = np.argsort(values)
            sorted_values = values[order]
            edge = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
            count = np.diff(np.concatenate([edge, [len(values)]]))
            flags = np.empty(len(values), np.uint8)
            flags[order] = np.repeat(np.where(count > hot, 2, count > 1).astype(np.uint8), count)
            flags = np.maximum(flags, again)
            at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            bucket = group["bucket"][0].as_py()
            for block, a, b in zip(group["block"].to_pylist(), at[:-1], at[1:]):
                if flags[a:b].any():
                    yield block, bucket, int((flags[a:b] == 2).sum()), flags[a:b].tobytes()

    return lambda batches: _batches(rows(batches), _FLAGS)


def _deal_runs(total: int, lo: int, hi: int, bits: int, hot: bool):
    """Runs of anchors that occur again, for the buckets lo..hi; of hot anchors the suffixes one by one, with salts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row, reports in _with_reports(batches):
            if not reports:
                continue
            raw, block = row["data"], row["block"]
            data = np.frombuffer(raw, np.uint8)
            place, size, value = _runs(data, _edges(row["sizes"])[0], bits)
            values = np.unique(value)
            flags = np.zeros(len(values), np.uint8)
            of_value = _bucket(values, total)
            for a, b in _cuts(of_value):
                if (told := reports.get(int(of_value[a]))) is not None:
                    flags[a:b] = np.frombuffer(told, np.uint8)
            flag = flags[np.searchsorted(values, value)]
            salt = -1
            if hot:
                own = flag == 2
                place, size = place[own], size[own]
                at = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())
                place, size = at, np.ones(len(at), np.int64)
                value = np.array([hash_of(raw[p : p + LENGTH], bits) for p in at.tolist()], np.uint64)
                salt = block % SALTS
            else:
                own = flag == 1
                place, size, value = place[own], size[own], value[own]
            bucket = _bucket(value, total)
            own = (bucket >= lo) & (bucket < hi)
            order = np.flatnonzero(own)[np.argsort(bucket[own], kind="stable")]
            place, size, bucket = place[order], size[order], bucket[order]
            ends = (place + size + LENGTH - 1).tolist()
            for a, b in _cuts(bucket):
                head = np.zeros(b - a, _HEAD)
                head["place"], head["size"] = place[a:b], size[a:b]
                texts = [raw[p:e] for p, e in zip(place[a:b].tolist(), ends[a:b])]
                first = dict(zip(reversed(texts), range(b - a - 1, -1, -1)))
                shown = sorted(first.values())
                head["shown"][shown] = 1
                yield int(bucket[a]), salt, block, head.tobytes(), b"".join([texts[i] for i in shown])

    return lambda batches: _batches(rows(batches), _DEALT)


def hash_of(string: bytes, bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little") >> (64 - bits) << (64 - bits)


class _Bucket:
    """The runs of one bucket in corpus order: ``head``, ``block`` and, of those shown, their bytes."""

    def __init__(self, group: pa.Table):
        blocks = group["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        heads = [np.frombuffer(x, _HEAD) for x in group["heads"].take(pa.array(order)).to_pylist()]
        self.head = np.concatenate(heads)
        self.block = np.repeat(blocks[order], [len(h) for h in heads])
        raw = b"".join(group["text"].take(pa.array(order)).to_pylist())
        shown = self.head["shown"] == 1
        length = self.head["size"][shown].astype(np.int64) + LENGTH - 1
        end = np.cumsum(length)
        first: dict[bytes, int] = {}
        for i, a, b in zip(np.flatnonzero(shown).tolist(), (end - length).tolist(), end.tolist()):
            first.setdefault(raw[a:b], i)
        self.texts = list(first)
        self.first = np.fromiter(first.values(), np.int64, len(first))

    def told(self, masks: np.ndarray | None) -> Iterator[tuple]:
        """Repeats of each block: all suffixes of a run that is not the first of its bytes, else what ``masks`` says."""
        out = np.zeros(len(self.head), _MASK)
        out["place"] = self.head["place"]
        out["mask"] = (np.uint64(1) << self.head["size"].astype(np.uint64)) - np.uint64(1)
        out["mask"][self.first] = 0 if masks is None else masks
        some = out["mask"] != 0
        out, block = out[some], self.block[some]
        for a, b in _cuts(block):
            yield int(block[a]), out[a:b].tobytes()


def _firsts_of_salts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First of each string of a bucket and salt; repeats of it as rows with text null and masks for heads."""

    def rows() -> Iterator[tuple]:
        for group in sorted_groups(batches, ["bucket", "salt"]):
            runs = _Bucket(group)
            bucket = group["bucket"][0].as_py()
            for block, masks in runs.told(None):
                yield bucket, 1, block, masks, b""
            head, block = runs.head[runs.first], runs.block[runs.first]
            for a, b in _cuts(block):
                yield bucket, 0, int(block[a]), head[a:b].tobytes(), b"".join(runs.texts[a:b])

    yield from _batches(rows(), _DEALT)


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for group in sorted_groups(batches, ["bucket"]):
            runs = _Bucket(group)
            size = runs.head["size"][runs.first].astype(np.int64)
            length = size + LENGTH - 1
            again = repeats(np.frombuffer(b"".join(runs.texts), np.uint8), np.cumsum(length) - length, size)
            bit = np.arange(len(again)) - np.repeat(np.cumsum(size) - size, size)
            masks = np.add.reduceat(np.where(again, np.uint64(1) << bit.astype(np.uint64), np.uint64(0)), np.cumsum(size) - size)
            yield from runs.told(masks)

    yield from _batches(rows(), _TOLD)


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For two residues the shift below V that brings both onto the cover."""
    r = np.arange(V)
    sampled = np.isin(r, COVER)
    both = sampled[(r[:, None, None] + r) % V] & sampled[(r[None, :, None] + r) % V]
    return both.argmax(axis=2)


def _ranked(words: np.ndarray, at: np.ndarray, offsets: range | tuple) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (numbers of lesser ones) of the strings at ``at`` made of the 8-byte words at ``offsets``, and the members of ties."""
    rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
    for k, offset in enumerate(offsets):
        key, old = words[at[tied] + offset].astype(np.uint64), rank[tied]
        order = np.lexsort((key, old)) if k else np.argsort(key)
        key, old, tied = key[order], old[order], tied[order]
        line = np.arange(len(tied))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        split = group.copy()
        split[1:] |= key[1:] != key[:-1]
        rank[tied] = old + np.maximum.accumulate(np.where(split, line, 0)) - np.maximum.accumulate(np.where(group, line, 0))
        tied = tied[~(split & np.concatenate([split[1:], [True]]))]
        if not len(tied):
            break
    return rank, tied


def repeats(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which suffixes have an equal one before them, in ``LENGTH`` bytes. Run r has ``size[r]`` suffixes from ``first[r]`` on."""
    words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    run_of = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inside = run_of(size)
    at = np.repeat(first, size) + inside
    length = size + V - 1  # positions of a run with DEPTH bytes
    sample_inside = run_of(length)
    sampled = np.isin(sample_inside % V, COVER)
    sample = (np.repeat(first, length) + sample_inside)[sampled]
    cover = np.full(len(text), -1, np.int32)
    cover[sample] = _ranked(words, sample, range(0, DEPTH, 8))[0]

    residue, shifts = inside % V, _shifts()
    again = np.zeros(len(at), bool)
    rank, todo = _ranked(words, at, (0, V - 8))
    while len(todo):
        # One step of a ternary quicksort in every tie at once.
        todo = todo[np.lexsort((todo, rank[todo]))]
        line, group = np.arange(len(todo)), rank[todo]
        opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        n = np.diff(np.concatenate([opens, [len(todo)]]))
        of = np.repeat(np.arange(len(opens)), n)
        pivot = todo[opens + n // 2][of]
        x, y = at[todo], at[pivot]
        shift = shifts[residue[todo], residue[pivot]]
        sign = np.sign(cover[x + shift] - cover[y + shift])
        for offset in (DEPTH, LENGTH - 8):
            same = np.flatnonzero(sign == 0)
            a, b = words[x[same] + offset].astype(np.uint64), words[y[same] + offset].astype(np.uint64)
            sign[same] = (a > b).astype(np.int32) - (a < b)
        equal = np.flatnonzero(sign == 0)
        earliest = np.ones(len(equal), bool)
        earliest[1:] = of[equal][1:] != of[equal][:-1]
        again[todo[equal[~earliest]]] = True
        less = np.bincount(of[sign < 0], minlength=len(opens))
        same = np.bincount(of[equal], minlength=len(opens))
        rank[todo] = group + np.where(sign < 0, 0, np.where(sign == 0, less[of], (less + same)[of]))
        left = np.where(sign < 0, less[of], np.where(sign == 0, 0, (n - less - same)[of]))
        todo = todo[left > 1]
    return again


def _with_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict | list]]:
    """Blocks with what was reported to them: in a sorted partition reports (no data) come before their block."""
    block, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["data"] is None:
                if block != row["block"]:
                    block, held = row["block"], []
                held.append((row["bucket"], row["report"]))
            else:
                yield row, dict(held) if held and block == row["block"] and held[0][0] is not None else [r for _, r in held if block == row["block"]]


def _beside(blocks: DataFrame, reports: DataFrame, parts: int) -> DataFrame:
    """Blocks and reports in one sorted partitioning by block: the input of :func:`_with_reports`."""
    kind = blocks.schema["ids"].dataType.simpleString()
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    bucket = F.col("bucket") if "bucket" in reports.columns else none("long", "bucket")
    told = reports.select("block", bucket, F.col(reports.columns[-1]).alias("report"), none(kind, "ids"), none("binary", "sizes"), none("binary", "data"))
    own = blocks.select("block", none("long", "bucket"), none("binary", "report"), "ids", "sizes", "data")
    both = own.unionByName(told).repartition(parts, "block").withColumn("last", F.col("data").isNotNull())
    return both.sortWithinPartitions("block", "last").drop("last")


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    with_text: bool = True,
    passes: int = PASSES,
    hot: int = HOT,
    hash_bits: int = 64,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept: binary if ``with_text``) for each document."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    size = blocks.select(F.sum(F.octet_length("data"))).first()[0] or 0
    total = max(64, size * 3 // 2 // BUCKET)  # runs with their bytes are 1.4 times the text where a third of it is repeated
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)

    sent = arrow_map(blocks.select("block", "sizes", "data"), _emit_anchors(total, hash_bits), _ddl(_ANCHORS))
    sent = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    flags = materialize(arrow_map(sent, _flag_anchors(hot), _ddl(_FLAGS)), "anchors")
    beside = _beside(blocks.withColumn("ids", F.lit(None).cast(blocks.schema["ids"].dataType)), flags, parts)

    told = []
    if not flags.where("hot > 0").isEmpty():
        single = arrow_map(beside, _deal_runs(total, 0, total, hash_bits, True), _ddl(_DEALT))
        single = single.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt")
        firsts = materialize(arrow_map(single, _firsts_of_salts, _ddl(_DEALT)), "hot-firsts")
        told.append(firsts.where("salt = 1").select("block", F.col("heads").alias("told")))
        meet = firsts.where("salt = 0").repartition(parts, "bucket").sortWithinPartitions("bucket")
        told.append(materialize(arrow_map(meet, _sort_buckets, _ddl(_TOLD)), "hot-repeats"))
    for k in range(passes):
        dealt = arrow_map(beside, _deal_runs(total, total * k // passes, total * (k + 1) // passes, hash_bits, False), _ddl(_DEALT))
        dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
        told.append(materialize(arrow_map(dealt, _sort_buckets, _ddl(_TOLD)), "repeats"))
    reports = told[0]
    for part in told[1:]:
        reports = reports.unionByName(part)

    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("ids").type.value_type
                yield batch

        for row, masks in _with_reports(watched()):
            out = _removed(row, masks)
            arrays = [pa.array(row["ids"], id_type), *(pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.string(), pa.binary())))]
            n = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])

    return arrow_map(_beside(blocks, reports, parts), removed, columns)


def _removed(row: dict, masks: list[bytes]) -> tuple[list, list, list, list, list]:
    edges, sizes = _edges(row["sizes"])
    mark = np.zeros(len(row["data"]) + 1, np.int32)
    for raw in masks:
        told = np.frombuffer(raw, _MASK)
        bit = np.flatnonzero(np.unpackbits(np.ascontiguousarray(told["mask"]).view(np.uint8), bitorder="little"))
        at = told["place"][bit >> 6].astype(np.int64) + (bit & 63)
        mark[at] += 1  # no place is reported twice
        mark[at + LENGTH] -= 1
    gone = np.cumsum(mark)[:-1] > 0
    data = np.frombuffer(row["data"], np.uint8)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed, spans, sha, kept = [], [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        n = int(total[b] - total[a])
        removed.append(n)
        own = gone[a:b]
        spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
        rest = data[a:b][~own].tobytes() if n else row["data"][a:b]
        kept.append(rest)
        sha.append(hashlib.sha256(rest).hexdigest())
    return sizes.tolist(), removed, spans, sha, kept
