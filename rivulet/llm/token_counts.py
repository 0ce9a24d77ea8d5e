"""Token counts of a SentencePiece model, with huge documents counted in overlapping chunks.

Documents up to ``CHUNK`` characters are encoded whole. A longer one is cut into chunks that overlap by ``OVERLAP``
characters, each encoded with the offsets of its pieces. Two neighbouring chunks are spliced at a common boundary: a
place inside the overlap where, in both, a piece ends and the next begins. The boundary has to be proven stable: no
piece of the model crosses from a character into a following word mark, so a space between printing ASCII characters
always separates pieces, whatever lies around it. If an overlap has no such place, it is doubled until one is found or
the chunk reaches the document's end, so a text without spaces ends up encoded whole. A model without that property
(checked when it is loaded) has no proof, and its documents are all encoded whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty table; repeated rows stay
repeated; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import arrow_map

CHUNK, OVERLAP = 32_768, 256
#: A boundary must be a space between two printing ASCII characters, which normalisation leaves alone.
_STABLE = re.compile(r"(?<=[!-~])(?= [!-~])")


class TokenCounter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.proven = not any(re.search("[^▁]▁", p) for p in pieces)
        self.chunk, self.overlap = chunk, overlap

    def counts(self, texts: list[str]) -> list[int]:
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk or not self.proven]
        out = [0] * len(texts)
        for k, ids in zip(short, self.model.encode([texts[k] for k in short], num_threads=1)):
            out[k] = len(ids)
        for k, t in enumerate(texts):
            if len(t) > self.chunk and self.proven:
                out[k] = self._count_long(t)
        return out

    def _ends(self, text: str) -> np.ndarray:
        """Ends of the pieces, in characters of the text; the library gives them in bytes."""
        ends = np.array([p.end for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        characters = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return np.concatenate([[0], characters])[ends]

    def _count_long(self, text: str) -> int:
        total, begin, counted = 0, 0, -1  # pieces that end up to ``counted`` are counted (the first may be empty); the chunk begins at ``begin``
        while True:
            overlap = self.overlap
            end = min(len(text), begin + self.chunk)
            ends = begin + self._ends(text[begin:end])
            if end == len(text):
                return total + int((ends > counted).sum())
            while (cut := self._splice(text, begin, end, ends, overlap, counted)) is None:
                overlap *= 2
                if 2 * overlap > end - begin:  # an overlap stays below half its chunk, so every splice goes forward
                    end = min(len(text), begin + 4 * overlap)
                    ends = begin + self._ends(text[begin:end])
                    if end == len(text):
                        return total + int((ends > counted).sum())
            place, begin = cut
            total += int(((ends > counted) & (ends <= place)).sum())
            counted = place

    def _splice(self, text: str, begin: int, end: int, ends: np.ndarray, overlap: int, counted: int) -> tuple[int, int] | None:
        """The last stable boundary common to this chunk and one that begins ``overlap`` before its end; that begin."""
        start = end - overlap
        places = [p for m in _STABLE.finditer(text[start:end]) if m.start() and (p := start + m.start()) > counted]
        if not places:
            return None
        after = start + self._ends(text[start:end])  # the next chunk, as far as the overlap reaches
        common = set(ends.tolist()) & set(after.tolist())
        good = [p for p in places if p in common]
        return (good[-1], start) if good else None


@lru_cache(maxsize=2)
def _counter(path: str, chunk: int, overlap: int) -> TokenCounter:
    return TokenCounter(path, chunk, overlap)


def token_counts(
    docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path, chunk, overlap)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            coded = texts.dictionary_encode()  # copies in a batch are counted once
            counts = np.array(counter.counts(coded.dictionary.to_pylist()), np.int64)
            n = counts[coded.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else np.zeros(0, np.int64)
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
