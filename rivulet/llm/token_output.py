"""Token-id output: Parquet list columns with chosen encodings, row groups and pages, readable in parts.

Documents are range-partitioned by id on sampled splitters and sorted, so files and rows are in ascending id order. Each
task encodes its documents with the ``tokenizers`` library and the Parquet writer keeps

* ``ids`` as a list column, dictionary-encoded (ids need 16 bits, less where a row group uses few different ones),
* ``part``, ``row``, ``doc_id`` and ``n_tokens`` as small columns of their own, delta-encoded by the version-2 writer
  once their dictionaries do not pay,

in row groups of ``ROW_GROUP`` bytes with pages of ``PAGE`` bytes and column indexes on every page. So a reader of the
metadata columns never touches the ids, and a reader of some documents skips row groups and pages by ``doc_id``.

Where each document starts in the whole sequence is a prefix sum in two levels: totals of parts (one row for each
task), then rows within a part, both over the metadata columns alone.

Words are encoded once for each worker as far as ``CACHE`` reaches: in this tokenizer family white space only ends a
match and is dropped, so ids of a text are the ids of its white-space words in a row. Words of Latin letters are looked up
in lower case and without the marks that close them. (A tokenizer without that property is detected when it is loaded, and
its texts are then encoded whole.)

Defined cases: null text counts as empty; a null id sorts first; rows with equal ids keep some order, the one of the
files; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.byte_bpe import spans
from rivulet.llm.common import arrow_map, write_once

ROW_GROUP, PAGE = 32 << 20, 256 << 10
CACHE = 600_000
#: Plain words: letters that are their own NFC form and have one letter for lower case (so not U+0130), which the tokenizer
#: takes as one match; with closing marks behind them, which are a match of their own.
_PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+$"
_MARKS = ".,;:!?"


class WordEncoder:
    """Ids of texts by a tokenizers file, with white-space words encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _drops_white_space(spec)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # odd words as they stand, and plain ones without closing marks in lower case
        self.pool = np.zeros(0, np.int32)
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)  # slot 0 is empty

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more than texts)."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for i in ids for x in i], np.int32), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        if len(self.known) > CACHE:
            self._forget()
        lists = pc.ascii_split_whitespace(texts)
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        slots = self._slots(coded.dictionary)
        n = self.size[slots].sum(axis=1)
        index = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n[index])])[at - at[0]]
        used = slots[index].ravel()
        used = used[used > 0]
        return self.pool[spans(self.first[used], self.size[used])], ends

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Two slots for each word: its letters and its closing marks; of an odd word all of it and nothing."""
        cores = pc.ascii_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(cores, _PLAIN)
        low = pc.utf8_lower(cores.filter(plain)).dictionary_encode()
        out = np.zeros((len(words), 2), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        marked = plain & (pc.binary_length(words).to_numpy(zero_copy_only=False) > pc.binary_length(cores).to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(words.filter(pa.array(marked)), f"^.*[^{_MARKS}]", "").dictionary_encode()
        odd = words.filter(pa.array(~plain)).to_pylist()
        names, ends = low.dictionary.to_pylist(), tails.dictionary.to_pylist()

        known, encode, model = self.known, self.tokenizer.encode, self.tokenizer.model.tokenize
        letters = [w for w in names if w not in known]
        others = list(dict.fromkeys(w for w in odd + ends if w not in known))
        shown = (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LEVEL) for w in letters)
        parts = [array("i", [t.id for t in model(w)]) for w in shown]
        parts += [array("i", encode(w, add_special_tokens=False).ids) for w in others]
        if parts:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            known.update(zip(letters + others, range(len(self.first), len(self.first) + len(parts))))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(parts), np.int32)])
        of = lambda strings: np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
        out[plain, 0] = of(names)[low.indices.to_numpy(zero_copy_only=False)] if names else 0
        out[marked, 1] = of(ends)[tails.indices.to_numpy(zero_copy_only=False)] if ends else 0
        out[~plain, 0] = of(odd)
        return out


def _byte_level() -> dict[int, int]:
    """Byte-level alphabet: bytes that print in Latin-1 stand for themselves, the others for 256, 257, ... in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTE_LEVEL = _byte_level()


def _drops_white_space(spec: dict) -> bool:
    """Whether the file's steps are the known ones by which white space only separates matches."""
    steps = [spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}]
    normal = [n.get("type") for n in steps[0].get("normalizers", [])]
    split = steps[1].get("pretokenizers", [{}])
    clean = split[0].get("type") == "Split" and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
    letters = clean and "[\\p{L}]+" in split[0].get("pattern", {}).get("Regex", "") and "[^\\s" in split[0]["pattern"]["Regex"]
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return normal == ["NFC", "Replace", "Lowercase"] and letters and added and not spec.get("post_processor")


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer_path: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group: int = ROW_GROUP,
    page: int = PAGE,
) -> None:
    """Write (part, row, doc_id, n_tokens, ids) for all documents to ``out`` in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = encoder.encode(batch.column(1))
            if end_id is not None:
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(row, row + n)),
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                ],
                names=["part", "row", "doc_id", "n_tokens", "ids"],
            )
            row += n

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = arrow_map(ordered, run, f"part int, row long, doc_id {kind}, n_tokens long, ids array<int>")
    options = {
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary": "true",
        "parquet.writer.version": "PARQUET_2_0",
    }
    write_once(encoded, out, **options)


def document_starts(meta: DataFrame) -> DataFrame:
    """(part, row, doc_id, n_tokens) with ``start``: the ids of all documents before."""
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # a row for each task
    rows = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return meta.join(parts, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(rows), F.lit(0))).drop("base")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all from the files: metadata columns for starts, ids for the checksums."""
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()).tolist()
            data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(np.diff(at))], names=["part", "row", "ids_crc32", "n_read"])

    sums = arrow_map(files.select("part", "row", "ids"), run, "part int, row long, ids_crc32 long, n_read long")
    starts = document_starts(files.select("part", "row", "doc_id", "n_tokens"))
    return starts.join(sums, ["part", "row"]).select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")
