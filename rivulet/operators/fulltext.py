"""Full text: analysis, postings, matching and BM25, as Column expressions and joins.

Analysis happens inside the JVM and keeps positions of dropped words, so phrases honour the gaps. Postings are an
ordinary DataFrame; written out clustered by term they serve any number of queries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import Unsupported
from rivulet.schema import Index
from rivulet.sources.shared import materialize

# The stop words of the english analyzer.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his in into is it its of on or she that the their then there these "
    "they this to was were which who will with"
).split()
#: Suffix, what replaces it, and the bytes a stem needs; the first that fits is applied.
SUFFIXES = (("ies", "y", 2), ("sses", "ss", 2), ("ing", "", 4), ("edly", "", 3), ("ed", "", 3), ("ly", "", 3), ("es", "", 3))
#: Fixed values of BM25.
K1, B = 1.2, 0.75
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
PORTABLE_TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Analyzer:
    language: str = "simple"
    stop_words: bool = False
    stemming: bool = False
    token: str = TOKEN

    @classmethod
    def of(cls, index: Index) -> Analyzer:
        return cls(index.language, index.stop_words, index.stemming)

    @property
    def _stops(self) -> bool:
        return self.language == "english" and self.stop_words

    @property
    def _stems(self) -> bool:
        return self.language == "english" and self.stemming

    def terms(self, text: Column) -> Column:
        """array<struct<pos, term>> of a text."""
        words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.token), F.lit(0)), F.lower)
        placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
        if self._stops:
            placed = F.filter(placed, lambda x: ~x["term"].isin(STOP_WORDS))
        if self._stems:
            placed = F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), stem(x["term"]).alias("term")))
        return placed

    def terms_of(self, text: str) -> list[tuple[int, str]]:
        """The same for a text of a query, by the same expression: words are cut, folded and stemmed alike on both sides."""
        spark = SparkSession.active()
        return [(t["pos"], t["term"]) for t in spark.range(1).select(self.terms(F.lit(text)).alias("t")).first()["t"]]


def stem(word: Column) -> Column:
    size = F.octet_length(word)
    out = None
    for suffix, new, least in SUFFIXES:
        fits = word.endswith(suffix) & (size >= len(suffix) + least)
        value = F.concat(F.substr(word, F.lit(1), F.length(word) - len(suffix)), F.lit(new))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    plural = word.endswith("s") & ~word.endswith("ss") & (size > 3)
    return out.when(plural, F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def text_column(df: DataFrame, name: str) -> Column:
    """A text column, or an array of texts joined by spaces."""
    return F.concat_ws(" ", name) if df.schema[name].dataType.typeName() == "array" else F.col(name)


def postings(df: DataFrame, key: str, text: str, analyzer: Analyzer) -> DataFrame:
    """(key, term, pos) for each kept word."""
    terms = df.select(key, F.explode(analyzer.terms(text_column(df, text))).alias("t"))
    return terms.select(key, "t.term", "t.pos")


def by_term(terms: Column) -> Column:
    """array<struct<term, positions>> of a text's terms: each term once with its positions ascending, by one sort in the row."""

    def runs(sorted_terms: Column) -> Column:
        begins = F.transform(sorted_terms, lambda x, i: F.struct(i.alias("at"), ((i == 0) | (x["term"] != F.get(sorted_terms, i - 1)["term"])).alias("new")))
        return _let(F.filter(begins, lambda x: x["new"]), lambda firsts: F.transform(firsts, lambda x, k: run(sorted_terms, x["at"], F.get(firsts, k + 1)["at"])))

    def run(sorted_terms: Column, begin: Column, end: Column) -> Column:
        places = F.slice(sorted_terms, begin + 1, F.coalesce(end, F.size(sorted_terms)) - begin)
        return F.struct(F.get(sorted_terms, begin)["term"].alias("term"), F.transform(places, lambda x: x["pos"]).alias("positions"))

    return _let(F.sort_array(F.transform(terms, lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos")))), runs)


def term_counts(df: DataFrame, key: str, text: str, analyzer: Analyzer) -> DataFrame:
    """(key, term, tf, first_pos) for each key and term.

    A row's words are counted in the row. Only rows that share their key with others are shuffled, to add up their counts.
    """
    shared = materialize(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key")), "fulltext-shared-keys")

    def counts(rows: DataFrame) -> DataFrame:
        terms = rows.select(key, F.explode(by_term(analyzer.terms(text_column(rows, text)))).alias("t"))
        return terms.select(key, "t.term", F.size("t.positions").cast("long").alias("tf"), F.get("t.positions", F.lit(0)).alias("first_pos"))

    rows, same = df.select(key, text), F.col(key).eqNullSafe(F.col("_key"))
    added = counts(rows.join(shared, same, "left_semi")).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))
    return counts(rows.join(shared, same, "left_anti")).unionByName(added)


def document_lengths(df: DataFrame, key: str, text: str, analyzer: Analyzer) -> DataFrame:
    """(key, dl): kept words of each document; a null text has none but is a document."""
    return df.select(key, F.size(analyzer.terms(text_column(df, text))).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))


@dataclass(frozen=True)
class Item:
    """One item of a match query: terms with positions; a prefix has one term."""

    kind: str  # term, prefix or phrase
    terms: tuple[tuple[int, str], ...]


def match_items(query: str, analyzer: Analyzer) -> list[Item]:
    """Items of ``word word* "some words"``, all of which must match.

    A prefix is folded but not stemmed. A word that analysis splits gives several items, one that it drops gives none.
    """
    if not query.strip():
        raise Unsupported("an empty match")
    items = []
    rest = query
    while rest := rest.strip():
        if rest[0] == '"':
            close = rest.find('"', 1)
            if close < 0:
                raise Unsupported("a phrase that is not closed")
            terms = analyzer.terms_of(rest[1:close])
            rest = rest[close + 1 :]
            if terms:
                items.append(Item("phrase" if len(terms) > 1 else "term", tuple((p - terms[0][0], t) for p, t in terms)))
            continue
        word, _, rest = rest.partition(" ")
        if '"' in word:
            rest, word = word[word.index('"') :] + " " + rest, word[: word.index('"')]
        if any(c in word for c in "~^()"):
            raise Unsupported("a match operator other than words, prefixes and phrases")
        if word in ("OR", "NOT", "AND"):
            raise Unsupported(f"{word} in a match")
        if "*" in word:
            if word.index("*") != len(word) - 1 or len(word) == 1:
                raise Unsupported("a star inside a word")
            items.append(Item("prefix", ((0, word[:-1].lower()),)))
            continue
        items += [Item("term", ((0, t),)) for _, t in analyzer.terms_of(word)]
    if not items:
        raise Unsupported("a match without a searchable word")
    return items


def _frequencies(post: DataFrame, key: str, item: Item) -> DataFrame:
    """(key, tf) of the documents where an item occurs."""
    if item.kind == "prefix":
        return post.where(F.col("term").startswith(item.terms[0][1])).groupBy(key).agg(F.count(F.lit(1)).alias("tf"))
    if item.kind == "term":
        return post.where(F.col("term") == item.terms[0][1]).groupBy(key).agg(F.count(F.lit(1)).alias("tf"))
    # A phrase: its terms' postings shifted to the anchor meet at one place.
    wanted = [t for _, t in item.terms]
    shifted = post.where(F.col("term").isin(wanted)).withColumn(
        "anchor", F.explode(F.filter(F.array(*(F.when(F.col("term") == t, F.struct((F.col("pos") - p).alias("at"), F.lit(k).alias("k"))) for k, (p, t) in enumerate(item.terms))), lambda x: x.isNotNull()))
    )
    places = shifted.groupBy(key, F.col("anchor.at").alias("at")).agg(F.countDistinct("anchor.k").alias("n")).where(F.col("n") == len(item.terms))
    return places.groupBy(key).agg(F.count(F.lit(1)).alias("tf"))


def _score(n_docs: Column, avg_len: Column, dl: Column, df: Column, tf: Column) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avg_len, F.lit(1.0))))


def with_score(df: DataFrame, text: str, query: str, analyzer: Analyzer) -> DataFrame:
    """The rows in which every item of ``query`` occurs, with ``_score`` by BM25 over all rows of ``df``.

    Two passes analyse each text once: one for the corpus's numbers - its size, mean length and each item's document
    frequency, a single row - and one for the scores. Nothing else is shuffled.
    """
    items = match_items(query, analyzer)
    return _scored(_counted(df, text, items, analyzer), df.columns, len(items))


def _counted(df: DataFrame, text: str, items: list[Item], analyzer: Analyzer) -> DataFrame:
    """``df`` with ``_dl``, its words, and ``_tf``, how often each item occurs."""
    counted = _let(analyzer.terms(text_column(df, text)), lambda terms: F.struct(F.size(terms).alias("dl"), _counts(terms, items).alias("tf")))
    rows = df.withColumn("_seen", counted)
    return rows.select(*df.columns, F.col("_seen.dl").alias("_dl"), F.col("_seen.tf").alias("_tf"))


def _scored(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    seen = [F.sum((F.col("_tf")[k] > 0).cast("long")) for k in range(n)]
    corpus = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), F.array(*seen).alias("_df"))
    found = rows.where(F.forall("_tf", lambda x: x > 0)).crossJoin(F.broadcast(corpus))  # one row
    parts = [_score(F.col("_n"), F.col("_avg"), F.col("_dl"), F.col("_df")[k], F.col("_tf")[k]) for k in range(n)]
    return found.select(*columns, sum(parts[1:], parts[0]).alias("_score"))


def bm25(df: DataFrame, key: str, text: str, query: str, analyzer: Analyzer) -> DataFrame:
    """(key, _score) of the documents in which every item of ``query`` occurs.

    The counts of all documents - a few numbers each - are written first, so texts are analysed once for both passes.
    """
    items = match_items(query, analyzer)
    counts = materialize(_counted(df.select(key, text), text, items, analyzer).select(key, "_dl", "_tf"), "fulltext-counts")
    return _scored(counts, [key], len(items))


def bm25_from_postings(post: DataFrame, lengths: DataFrame, key: str, query: str, analyzer: Analyzer) -> DataFrame:
    """The same from stored postings and lengths: only the postings of the query's terms are read."""
    items = match_items(query, analyzer)
    found = None
    for k, item in enumerate(items):
        part = _frequencies(post, key, item).withColumn("item", F.lit(k))
        found = part if found is None else found.unionByName(part)
    df_of = found.groupBy("item").agg(F.count(F.lit(1)).alias("df"))  # a row for each item of the query
    scored = found.join(F.broadcast(df_of), "item").join(lengths, key).crossJoin(F.broadcast(corpus_stats(lengths)))
    part = _score(F.col("n_docs"), F.col("avg_len"), F.col("dl"), F.col("df"), F.col("tf"))
    return scored.groupBy(key).agg(F.sum(part).alias("_score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(items)).drop("n")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it: the optimizer copies plain expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _counts(terms: Column, items: list[Item]) -> Column:
    """How often each item occurs, counted among the terms that some item speaks of."""
    exact = sorted({t for item in items if item.kind != "prefix" for _, t in item.terms})
    tests = [lambda x: x["term"].isin(exact)] * bool(exact) + [_begins(item.terms[0][1]) for item in items if item.kind == "prefix"]
    asked = F.filter(terms, lambda x: reduce(or_, (test(x) for test in tests)))
    return _let(asked, lambda some: F.array(*(_occurrences(some, item) for item in items)))


@dataclass(frozen=True)
class StoredIndex:
    """Postings clustered by term and document lengths, as tables: a query reads the row groups of its terms alone."""

    post: DataFrame
    lengths: DataFrame

    @classmethod
    def write(cls, df: DataFrame, key: str, text: str, analyzer: Analyzer, path: str) -> StoredIndex:
        # Texts are analysed once: the sampling of ranges, the postings and the lengths read what is written here.
        terms = materialize(df.select(key, analyzer.terms(text_column(df, text)).alias("_terms")), "fulltext-terms")
        post = terms.select(key, F.explode("_terms").alias("t")).select(key, "t.term", "t.pos")
        # Common terms are split over files by key; a term's postings lie together all the same.
        post.repartitionByRange("term", key).sortWithinPartitions("term", key, "pos").write.parquet(f"{path}/postings")
        terms.select(key, F.size("_terms").cast("long").alias("dl")).write.parquet(f"{path}/lengths")
        return cls.read(df.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> StoredIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def scores(self, key: str, query: str, analyzer: Analyzer) -> DataFrame:
        return bm25_from_postings(self.post, self.lengths, key, query, analyzer)


def _occurrences(terms: Column, item: Item) -> Column:
    """How often an item occurs among the terms of a text."""
    if item.kind == "prefix":
        return F.size(F.filter(terms, _begins(item.terms[0][1])))
    if item.kind == "term":
        return F.size(F.filter(terms, _is(item.terms[0][1])))
    places = [F.transform(F.filter(terms, _is(t)), _before(p)) for p, t in item.terms]
    common = places[0]
    for other in places[1:]:
        common = F.array_intersect(common, other)
    return F.size(common)


def _is(term: str):
    return lambda x: x["term"] == term


def _begins(prefix: str):
    return lambda x: x["term"].startswith(prefix)


def _before(distance: int):
    return lambda x: x["pos"] - distance


def matches(text: Column, query: str, analyzer: Analyzer) -> Column:
    """Whether a text matches, by itself: the predicate for filters and live deltas."""
    items = match_items(query, analyzer)
    return F.forall(_counts(analyzer.terms(text), items), lambda n: n > 0)
