"""Language identification by rank-order profiles.

Learning: over all training documents, n-grams of one to three characters are counted for each language in parallel and
summed by Spark; the ``PROFILE`` most frequent ones of each language, in order, are its profile. Predicting: a document's
own most frequent n-grams are compared to every profile by the out-of-place distance - the sum over them of how far
their ranks differ, ``PROFILE`` for those the profile lacks - and the nearest language is taken (ties: by name).

Text is lower-cased; a character is kept if it is a letter, and a run of others counts as one boundary, which may begin
or end an n-gram but does not stand inside one. Equal counts are ranked by character codes, so ranks are the same
everywhere. The score is 1 - distance / greatest possible distance: 1 for a text that ranks like its profile, 0 for one
that shares no n-gram with any.

What goes to the driver and to tasks is one profile of ``PROFILE`` n-grams for each language, and of ``LANGUAGES`` of them
at most, whatever the corpus size: a column with more labels than that is no longer one of languages, and those with
the most text are learned.

Defined cases: ``und`` with score 0 if text is null or has no letter, or if no language was learned; training rows with
a null language or text are not learned from; an empty table gives an empty table; long texts are counted in slices of
``SLICE`` characters; other columns are not read by the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.byte_bpe import spans
from rivulet.llm.common import arrow_map, materialize

PROFILE = 400
#: Most labels that are learned: about what the widest collections of text in known languages have.
LANGUAGES = 2048
SLICE = 1 << 20
_NONE = 0x1FFFFF
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """1 at the code points of letters."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _letter


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed 21 bits a character, and their counts."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([[0], np.where(_letters()[code], code, 0), [0]]).astype(np.uint32)
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(code), SLICE):
        # An n-gram belongs to the slice that holds its last character.
        skip = min(a, 2)
        one = np.unique(_grams(code[a - skip : a + SLICE].astype(np.int64), skip), return_counts=True)
        if len(keys):
            keys, back = np.unique(np.concatenate([keys, one[0]]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, one[1]]), len(keys)).astype(np.int64)
        else:
            keys, counts = one
    return keys, counts


def _grams(c: np.ndarray, skip: int) -> np.ndarray:
    one = c[skip:]
    one = one[one != 0] | (_NONE << 42) | (_NONE << 21)
    a, b = c[max(0, skip - 1) : -1], c[max(1, skip) :]
    two = ((_NONE << 42) | (a << 21) | b)[(a != 0) | (b != 0)]
    m = max(2, skip)
    a, b, d = c[m - 2 : -2], c[m - 1 : -1], c[m:]
    three = ((a << 42) | (b << 21) | d)[b != 0]
    return np.concatenate([one, two, three])


def most_frequent(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent keys in order."""
    if len(keys) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        few = counts >= least
        keys, counts = keys[few], counts[few]
    return keys[np.lexsort((keys, -counts))][:n]


def learn_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, languages: int = LANGUAGES) -> dict[str, np.ndarray]:
    """The profile of each language over all rows of ``train``; of more than ``languages`` labels, those whose profiles count the
    most n-grams (ties: by name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            index = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(0).filter(pa.array(index == k)).to_pylist()
                # One boundary between documents: joined, they give the same n-grams as each alone.
                keys, counts = gram_counts("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    source = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = arrow_map(source, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(*order)  # so no task ranks a whole language
    few = sums.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size)
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    top = materialize(top.select("lang", "gram", "r", "n"), "language-profiles")
    most = top.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    found = top.join(F.broadcast(most), "lang", "left_semi").select("lang", "gram", "r").toArrow()  # ``languages`` times ``size`` rows at most
    found = found.sort_by([("lang", "ascending"), ("r", "ascending")])
    langs, sizes = np.unique(np.array(found["lang"].to_pylist(), object), return_counts=True)
    grams = np.split(found["gram"].to_numpy(), np.cumsum(sizes)[:-1])
    return dict(zip(langs.tolist(), grams))


class ProfileTable:
    """The n-grams of all profiles, each with the languages that have it and its ranks there."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = list(profiles), size
        grams = np.concatenate([*profiles.values(), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(grams, kind="stable")
        self.keys, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.lang = np.repeat(np.arange(len(profiles)), np.array([len(g) for g in profiles.values()], np.int64))[order]
        self.rank = np.concatenate([*(np.arange(len(g)) for g in profiles.values()), np.zeros(0, np.int64)])[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = most_frequent(*gram_counts(text), self.size) if text else np.zeros(0, np.int64)
        if not len(grams) or not len(self.keys):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == grams)
        at = at[known]
        held = self.first[at + 1] - self.first[at]
        entry = spans(self.first[at], held)
        # What a profile lacks is ``size`` away; what it has is nearer by so much.
        nearer = self.size - np.abs(self.rank[entry] - np.repeat(known, held))
        away = self.size * len(grams) - np.bincount(self.lang[entry], nearer, len(self.langs))
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(grams)))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``carry``) as struct ``doc`` with lang_pred and score."""
    table = ProfileTable(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            found = [table.predict(t) for t in coded.dictionary.to_pylist()] + [("und", 0.0)]
            index = pc.fill_null(coded.indices, len(found) - 1).to_numpy(zero_copy_only=False)
            lang = pa.array([x[0] for x in found], pa.string()).take(pa.array(index))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(np.array([x[1] for x in found])[index])], names=["doc", "lang_pred", "score"])

    source = docs.select(F.struct(*(carry or ["*"])).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    return arrow_map(source, run, f"doc {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))
