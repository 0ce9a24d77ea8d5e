"""Benchmark decontamination by an FM-index for each shard of the training documents.

Words are the runs of bytes that are no ASCII control, space, punctuation or capital (after lower-casing A-Z). Test
phrases are the windows of 13 consecutive words of an item; an item with fewer words, but not none, is one phrase.

A task cuts its documents into shards of at most ``SHARD`` words and, for each, builds an FM-index over the sequence of
its words: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet tree with rank counts for every 64
positions, and positions sampled every ``SAMPLE`` words. All phrases are then searched backward at once, each step two
wavelet-tree ranks; the suffix positions of what is found come from walking back to sampled positions. The spans
are merged into hit words. Words that no phrase has cannot take part in an occurrence: they end a segment of the
sequence, as does a document's end, so they are neither sorted nor stored.

Phrases go to the tasks in blocks of at most ``BLOCK_BYTES`` of item text, one pass over the documents for each block
(one block for anything below that size), so neither the driver nor a task holds more, whatever the benchmark's size.
Documents longer than a shard are cut with 12 words of overlap, so a shard's memory is bounded too. There is no shuffle
with one block.

Defined cases: null texts have no words (n_words 0, not contaminated); items without words are never found; equal
item_ids count once; equal document rows stay separate rows; an empty table on either side gives rows without hits or no rows; other columns are
carried in a struct and never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.byte_bpe import spans
from rivulet.llm.common import arrow_map, materialize

WINDOW = 13
SHARD, SAMPLE = 1 << 20, 8
#: Item text of one block; its windows take up to some 50 times as much, held by the driver and once by each worker.
BLOCK_BYTES = 2 << 20
#: Bytes of words: digits, small letters and all bytes of characters beyond ASCII.
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts data[edges[i]:edges[i + 1]], and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    data = _LOWER[data]
    word = _IS_WORD[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    starts[cut] = word[cut]
    first = np.flatnonzero(starts)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = cut - 1
    ends[inner] = word[inner]
    last = np.flatnonzero(ends)
    # The hash takes eight bytes at a time, so a word of n bytes takes n / 8 rounds over the words that are so long.
    size = last - first + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = size.astype(np.uint64) * _M1
    todo = np.arange(len(first))
    at = 0
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    while len(todo):
        piece = np.ascontiguousarray(eights[first[todo] + at]).view("<u8")[:, 0] & masks[np.minimum(size[todo] - at, 8)]
        x = (out[todo] ^ piece) * _M2
        out[todo] = (x ^ (x >> np.uint64(29))) * _M1 ^ (x >> np.uint64(32))
        at += 8
        todo = todo[size[todo] > at]
    return out, np.searchsorted(first, edges)


class Phrases:
    """The phrases of a block of items, as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, str]]):
        texts = [t.encode() for _, t in items]
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words, at = word_hashes(np.frombuffer(b"".join(texts), np.uint8), edges)
        self.words = np.unique(words)  # word k + 1 of a phrase is words[k]; 0 is no word
        numbers = np.concatenate([np.searchsorted(self.words, words) + 1, np.zeros(WINDOW, np.int64)])
        n = np.diff(at)
        windows = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
        owner = np.repeat(np.arange(len(n)), windows)
        column = np.arange(WINDOW)
        rows = np.where(column < n[owner][:, None], numbers[spans(at[:-1], windows)[:, None] + column], 0)
        self.rows, phrase = np.unique(rows, axis=0, return_inverse=True)
        self.sizes = (self.rows > 0).sum(axis=1)
        order = np.argsort(phrase.ravel(), kind="stable")
        self.owners = owner[order]
        self.owner_at = np.searchsorted(phrase.ravel()[order], np.arange(len(self.rows) + 1))
        self.item_ids = [i for i, _ in items]


class WaveletTree:
    """A sequence of numbers below 2**bits, level by level, with ranks of ones before every 64th position."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.n = bits, len(sequence)
        self.zeros, self.words, self.counts = [], [], []
        now = sequence
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
            self.zeros.append(int(self.n - bit.sum()))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & below)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each position."""
        low, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = (value >> (self.bits - 1 - k)) & 1 == 1
            ones_at, ones_low = self._ones(k, at), self._ones(k, low)
            at = np.where(one, self.zeros[k] + ones_at, at - ones_at)
            low = np.where(one, self.zeros[k] + ones_low, low - ones_low)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each position, and how often it occurs before."""
        value, low, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.bits):
            bit = ((self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones_at, ones_low = self._ones(k, at), self._ones(k, low)
            at = np.where(bit == 1, self.zeros[k] + ones_at, at - ones_at)
            low = np.where(bit == 1, self.zeros[k] + ones_low, low - ones_low)
            value = (value << 1) | bit
        return value, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that are not yet alone with their prefix are sorted again.

    ``text`` holds numbers >= 0; the zeros end segments and rank below all others, in order of place, so no comparison
    goes past one.
    """
    n = len(text)
    ends = text == 0
    k = int(ends.sum())
    first = np.where(ends, np.cumsum(ends) - 1, text + (k - 1))
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    size = np.diff(np.concatenate([np.flatnonzero(start), [n]]))
    places = np.flatnonzero(np.repeat(size > 1, size))  # where in the order groups are left
    step = 1
    while len(places):
        suffix = order[places]
        key = rank[suffix] * np.int64(n + 1) + rank[np.minimum(suffix + step, n - 1)]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[places] = suffix  # groups keep their places, since the old rank leads the key
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(places)]]))
        places = places[np.repeat(size > 1, size)]
        step *= 2
    return order


class FmIndex:
    """Over a sequence of numbers in which zeros end segments; the last number must be zero."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = len(text)
        order = suffix_array(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletTree(text[order - 1], max(1, int(symbols - 1).bit_length()))
        # Segment starts are sampled as well, so walking back never leaves a segment.
        sampled = (order % sample == 0) | (text[order - 1] == 0)
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix-array interval [low, high) of each phrase, empty where it does not occur."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.tree.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((sizes >= back) & (high > low))
            if not len(live):
                continue
            symbol = phrases[live, sizes[live] - back]
            base = self.before[symbol]
            ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = base + ranks[: len(live)], base + ranks[len(live) :]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the text of places in the suffix array."""
        out = np.zeros(len(at), np.int64)
        todo, steps = np.arange(len(at)), 0
        at = at.copy()
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.sample_at[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                value, before = self.tree.access(at)
                at = self.before[value] + before
            steps += 1
        return out


def occurrences(words: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and phrase numbers of all occurrences within texts words[at[i]:at[i + 1]]."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.words) or not len(words):
        return none
    number = np.minimum(np.searchsorted(phrases.words, words), len(phrases.words) - 1)
    kept = np.flatnonzero(phrases.words[number] == words)
    if not len(kept):
        return none
    ends = np.zeros(len(words) + 1, bool)
    ends[at] = True
    gap = np.zeros(len(kept), bool)  # something stands between a kept word and the one before
    gap[1:] = (np.diff(kept) > 1) | ends[kept[1:]]
    place = np.arange(len(kept)) + np.cumsum(gap)
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = number[kept] + 1
    back = np.full(len(text), -1, np.int64)
    back[place] = kept
    symbols = np.unique(text)  # the alphabet of this shard: its own words, and zero
    rows = np.minimum(np.searchsorted(symbols, phrases.rows), len(symbols) - 1)
    possible = np.flatnonzero(((symbols[rows] == phrases.rows) | (phrases.rows == 0)).all(axis=1))
    if not len(possible):
        return none
    index = FmIndex(np.searchsorted(symbols, text), len(symbols))
    low, high = index.search(rows[possible], phrases.sizes[possible])
    n = np.maximum(high - low, 0)
    ends_at = np.cumsum(n)
    every = np.arange(ends_at[-1]) + np.repeat(low - (ends_at - n), n)
    return back[index.locate(every)], np.repeat(possible, n)


def _judge(batch: pa.RecordBatch, phrases: Phrases) -> tuple[np.ndarray, list[bytes], list[list[str]]]:
    """Of each text: number of words, spans of hit words as pairs of int64, ids of items found."""
    texts = pc.cast(pc.fill_null(batch.column(1), ""), pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    words, at = word_hashes(data, edges - edges[0])
    n_words = np.diff(at)
    found: list[bytes] = [b""] * len(texts)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    starts, numbers = [], []
    for a in range(0, len(words), SHARD - WINDOW + 1):
        b = min(len(words), a + SHARD)
        inside = np.unique(np.clip(at, a, b)) - a
        s, p = occurrences(words[a:b], inside, phrases)
        starts.append(s + a)
        numbers.append(p)
        if b == len(words):
            break
    if not starts or not sum(map(len, starts)):
        return n_words, found, [[]] * len(texts)
    start, number = np.concatenate(starts), np.concatenate(numbers)
    text = np.searchsorted(at, start, side="right") - 1
    pair = np.unique(text * np.int64(len(phrases.rows)) + number)  # phrases of a text, once each
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + phrases.sizes[number], -1)
    hit = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
    for t in np.unique(text).tolist():
        own = hit[at[t] : at[t + 1] + 2].copy()
        own[0] = own[-1] = False
        edge = np.flatnonzero(own[1:] != own[:-1])
        found[t] = edge.astype("<i8").tobytes()
    owner_text, owner_phrase = pair // len(phrases.rows), pair % len(phrases.rows)
    for t, p in zip(owner_text.tolist(), owner_phrase.tolist()):
        items[t].update(phrases.item_ids[o] for o in phrases.owners[phrases.owner_at[p] : phrases.owner_at[p + 1]].tolist())
    return n_words, found, [sorted(x) for x in items]


def _digest(spans: list[bytes], items: list[list[str]], n_words: np.ndarray) -> list[pa.Array]:
    n_hit = []
    for x in spans:
        edge = np.sort(np.frombuffer(x, "<i8").reshape(-1, 2), axis=0) if x else np.zeros((0, 2), np.int64)
        n_hit.append(int((edge[:, 1] - edge[:, 0]).sum()))
    n_hit = np.array(n_hit, np.int64)
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words))]


def _merged(parts: list[bytes]) -> bytes:
    """Union of spans of hit words found with different blocks of items."""
    edge = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts]) if parts else np.zeros((0, 2), np.int64)
    edge = edge[np.argsort(edge[:, 0], kind="stable")]
    top = np.maximum.accumulate(edge[:, 1]) if len(edge) else edge[:, 1]
    new = np.concatenate([[True], edge[1:, 0] > top[:-1]]) if len(edge) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(edge) - 1]]) if len(edge) else first
    return np.stack([edge[first, 0], top[last]], axis=1).astype("<i8").tobytes()


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded bytes, streamed through the driver; one item's text is the least a block can hold."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).withColumn("n", F.octet_length("t")).where("n > 0")
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + row["n"] > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += row["n"]
    yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """(doc: struct of the row, or of its columns in ``carry``, n_words, n_hit, n_items, items_sha256, contaminated) for each document."""
    spark = docs.sparkSession
    source = docs.select(F.struct(*(carry or ["*"])).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    blocks = _item_blocks(benchmark, item_col, item_text_col, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        held = spark.sparkContext.broadcast(Phrases(block))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = _judge(batch, held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *_digest(spans, items, n_words)], names=["doc", *_NAMES])

        return arrow_map(source, one, f"doc {kind}, {COLUMNS}")

    # Several passes need a row key: the rows are written once with one.
    source = materialize(source.withColumn("key", F.monotonically_increasing_id()), "decontaminate")
    found = None
    while block is not None:
        held = spark.sparkContext.broadcast(Phrases(block))

        def each(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = _judge(batch, held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "spans", "items"])

        part = materialize(arrow_map(source.select("key", "text"), each, "key long, n_words long, spans binary, items array<string>"), "contamination")
        found = part if found is None else found.unionByName(part)
        block, more = more, next(blocks, None)
        held.unpersist()
    found = found.groupBy("key").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digest(spans, batch.column(3).to_pylist(), batch.column(1).to_numpy())], names=["key", *_NAMES])

    merged = arrow_map(found, merge, f"key long, {COLUMNS}")
    return source.join(merged, "key").select("doc", *_NAMES)
