"""Byte-level BPE encoding and decoding by ranks, on length-bucketed padded numpy matrices.

Texts are cut into matches of a pattern, each encoded separately; for the pattern of word pieces, letters, numbers and
spaces are what tiktoken's own tables say, whatever Unicode version ``regex`` has. The distinct matches of a batch go into matrices of
token ids, one matrix for lengths up to 4, 8, 16, ... 256 bytes. In each round every row merges its leftmost pair of
least rank; only the two pairs beside a merge are looked up again, in an open-addressing hash table of all pairs whose
concatenation is a token; finished rows leave the matrix (compaction). Matches above 256 bytes, where a matrix would be
quadratic, follow the same rule through a heap over linked positions.

A worker keeps the ids of matches it has met, up to ``CACHE`` of them, then starts anew. Text is handled as Arrow
batches with bounded bytes.

Defined cases: a null text counts as empty (no ids); an empty table gives an empty table; documents with equal ids stay
separate rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import arrow_map, binaries

NONE = np.int64(1 << 40)
WIDEST = 256
CACHE = 300_000
#: White space beside a space, or a space at an end. In a text without it each space stands between two other characters
#: and starts a match of its own, whatever the words are.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"{_SPACE} | {_SPACE}|^ | $"
#: The pattern (a fixed value) for which words between single spaces can be cut by themselves; texts are cut whole by any other.
_BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A letter, a number, a space and a mark on which all Unicode versions agree.
_LIKE = "\u2135\u00b2\u2003\u2020"


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each span, one span after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


@lru_cache(maxsize=1)
def strange_characters() -> dict[int, str]:
    """Characters that ``regex`` or ``str.isalpha`` class otherwise than tiktoken's own tables do -> one that all class so.

    Unicode versions differ between the libraries. tiktoken's classes are read off by encoding all characters with patterns
    that match one class: what a pattern does not match gives no ids."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    classes = (r"\p{L}", r"\p{N}", r"\s")
    theirs = [set(bytes(tiktoken.Encoding("class", pat_str=c, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()) for c in classes]
    differ = {c for c in every if c.isalpha()} ^ theirs[0]
    for c, own in zip(classes, theirs):
        differ |= set(regex.findall(c, every)) ^ own
    return {ord(c): next((like for like, own in zip(_LIKE, theirs) if c in own), _LIKE[-1]) for c in differ}


def _one_of(characters: Iterable[int]) -> str:
    """A character class of the code points, as ranges."""
    ranges: list[list[int]] = []
    for c in sorted(characters):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]" if ranges else r"[^\x{0}-\x{10ffff}]"


class PairTable:
    """(left id, right id) -> id of the merged token, whose rank it also is."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens) if t is not None}
        pairs = [
            (ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids
        ]
        self.bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, right, value = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        keys = (left << 20) | right
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]], self.values[slot[take]] = keys[take], value[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, value, slot = keys[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair is no token; negative ids are padding and pair with nothing."""
        keys = (left << 20) | right
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], NONE)
        todo = np.flatnonzero((at != keys) & (at != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBpe:
    """Ranks of a tiktoken file; ``pattern`` cuts texts into the strings that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens: list[bytes] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.by_words = pattern == _BY_WORDS
        self.like = strange_characters() if self.by_words else {}
        strange = _one_of(self.like)
        self.unsafe = f"{_UNSAFE}|{strange}" if self.by_words else ""  # "" is found in any text
        self.strange = frozenset(map(chr, self.like))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(self.tokens)
        sizes = np.array([len(t or b"") for t in self.tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(sizes)])
        self.token_bytes = np.frombuffer(b"".join(t or b"" for t in self.tokens), np.uint8)
        self._forget()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the strings, each as one unit: all ids, and each string's first and number of ids."""
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, numbers of ids, ids
        width, low = 4, -1
        while width <= WIDEST:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            step = max(1, (1 << 20) // width)
            for a in range(0, len(rows), step):
                self._merge_matrix(strings, rows[a : a + step], sizes, width, done)
            low, width = width, width * 2
        for r in np.flatnonzero(sizes > WIDEST):
            ids = self._merge_long(strings[r])
            done.append((np.array([r]), np.array([len(ids)]), ids))
        start, count = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        total = 0
        for rows, n, ids in done:
            start[rows] = total + np.cumsum(n) - n
            count[rows] = n
            total += len(ids)
        flat = np.concatenate([x[2] for x in done]) if done else np.zeros(0, np.int64)
        return flat.astype(np.uint32), start, count

    def _merge_matrix(self, strings, rows, sizes, width, done) -> None:
        n = sizes[rows]
        flat = np.frombuffer(b"".join(strings[r] for r in rows.tolist()), np.uint8)
        ids = np.full((len(rows), width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < n[:, None]] = self.byte_id[flat]
        ranks = np.full((len(rows), width), NONE, np.int64)
        ranks[:, : width - 1] = self.pairs.find(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(len(rows), -1)
        columns = np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            go = low != NONE
            if not go.all():
                stop = ~go
                done.append((rows[stop], n[stop], ids[stop][columns < n[stop][:, None]]))
                rows, n, ids, ranks, at, low = rows[go], n[go], ids[go], ranks[go], at[go], low[go]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            shift = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            ids[line, at] = low
            n = n - 1
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :width], width - 1), 1)
            ranks[:, width - 1] = NONE
            ranks[line, at] = self.pairs.find(ids[line, at], ids[line, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])

    def _merge_long(self, string: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(string, np.uint8)].tolist()
        end = len(ids)
        following, previous = list(range(1, end + 1)), list(range(-1, end - 1))
        first = self.pairs.find(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            rank = int(self.pairs.find(np.array([ids[i]]), np.array([ids[j]]))[0])
            if rank != NONE:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], following[i] = rank, -1, following[j]
            if following[i] < end:
                previous[following[i]] = i
                push(i, following[i])
            if previous[i] >= 0:
                push(previous[i], i)
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more than texts)."""
        if len(self.known) > CACHE:
            self._forget()
        texts = pc.fill_null(texts, "")
        # Words between single spaces are looked up as wholes; texts with other uses of spaces are cut by the pattern.
        plain = pc.invert(pc.match_substring_regex(texts, self.unsafe))
        lists = pc.split_pattern(texts, " ")
        start = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(start[0], start[-1] - start[0]).dictionary_encode()
        start = start - start[0]
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        plain = plain.to_numpy(zero_copy_only=False)
        whole = np.repeat(plain, np.diff(start))
        head = np.zeros(len(index), bool)
        head[start[:-1][np.diff(start) > 0]] = True
        words = np.unique(index[whole & ~head])
        units = [" " + names[i] for i in words.tolist()]
        slot_of = np.full(len(names) or 1, -1, np.int64)
        slot_of[words] = np.arange(len(units))
        odd: dict[str, int] = {}
        order: list[np.ndarray] = []
        flags = plain.tolist()
        strings = texts.to_pylist() if not all(flags) else None
        for d, (a, b) in enumerate(zip(start[:-1].tolist(), start[1:].tolist())):
            if flags[d]:
                first = names[index[a]] if b > a else ""
                order.append(np.concatenate([[-1 - odd.setdefault(first, len(odd))], slot_of[index[a + 1 : b]]]))
            else:
                found = self._cut(strings[d])
                order.append(np.array([-1 - odd.setdefault(x, len(odd)) for x in found], np.int64))
        slots = self._slots(units + list(odd))
        used = np.concatenate(order) if order else np.zeros(0, np.int64)
        used = slots[np.where(used < 0, len(units) - 1 - used, used)] if len(used) else used
        n = self.size[used]
        ends = np.concatenate([[0], np.cumsum(n)])
        of_text = np.concatenate([[0], np.cumsum([len(x) for x in order])]).astype(np.int64)
        return self.pool[spans(self.first[used], n)], ends[of_text]

    def _cut(self, text: str) -> list[str]:
        """Matches of the pattern, with letters, numbers and spaces as tiktoken classes them."""
        if text.isascii() or self.strange.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.like))]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slots(self, units: list[str]) -> np.ndarray:
        """Where first and size hold each unit's place in the pool; units that are not there yet are encoded."""
        known = self.known
        new = [u for u in units if u not in known]
        if new:
            match: dict[str, int] = {}
            parts: list[int] = []
            counts = []
            for u in new:
                if not self.by_words or (u[1:].isalpha() and (u[0] == " " or u[0].isalpha()) and (u.isascii() or self.strange.isdisjoint(u))):
                    parts.append(match.setdefault(u, len(match)))  # a space and letters are one match
                    counts.append(1)
                else:
                    found = self._cut(u)
                    parts += [match.setdefault(m, len(match)) for m in found]
                    counts.append(len(found))
            flat, start, size = self.merge([m.encode() for m in match])
            parts, counts = np.array(parts, np.int64), np.array(counts, np.int64)
            per_part = size[parts]
            edge = np.concatenate([[0], np.cumsum(per_part)])
            of_unit = edge[np.concatenate([[0], np.cumsum(counts)])]
            known.update(zip(new, range(len(self.first), len(self.first) + len(new))))
            self.first = np.concatenate([self.first, len(self.pool) + of_unit[:-1]])
            self.size = np.concatenate([self.size, np.diff(of_unit)])
            self.pool = np.concatenate([self.pool, flat[spans(start[parts], per_part)]])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each id's begin (one more than ids)."""
        ids = ids.astype(np.int64)
        n = self.token_start[ids + 1] - self.token_start[ids]
        return self.token_bytes[spans(self.token_start[ids], n)], np.concatenate([[0], np.cumsum(n)])


@lru_cache(maxsize=4)
def _bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.from_file(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>, decoded: binary) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            ids, at = bpe.encode_batch(batch.column(1))
            data, byte_at = bpe.decode(ids)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            edge = byte_at[at].tolist()
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, binaries([raw[a:b] for a, b in zip(edge[:-1], edge[1:])])], names=[id_col, "ids", "decoded"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as :func:`encode_decode`, with hashes in place of ids and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            ids, at = bpe.encode_batch(batch.column(1))
            data, byte_at = bpe.decode(ids)
            edge = byte_at[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), _sha256(ids.astype("<u4").view(np.uint8), at * 4), _sha256(data, edge)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha256(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    edges = edges.tolist()
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:])], pa.string())
