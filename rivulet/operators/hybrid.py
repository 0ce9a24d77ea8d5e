"""Dense retrieval, rank fusion and reranking."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.order import numbered

#: The fusion constant, and how many rows reach retrievers and rerankers.
RRF_K, TOP = 60, 100
_HOOK_ERRORS = (PySparkException, ArithmeticError, LookupError, RuntimeError, TypeError, ValueError)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a constant vector; null where a length is zero."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = sum(x * x for x in map(float, query)) ** 0.5
    own = F.sqrt(dot(vector, F.transform(vector, lambda x: x.cast("double"))))
    return F.when((own > 0) & F.lit(size > 0), dot(vector, q) / (own * F.lit(size)))


def vector_topk(df: DataFrame, key: str, vector: str, query: list[float], k: int = TOP) -> DataFrame:
    """(key, score) of the k nearest, ties by key; each task keeps k rows."""
    return df.select(key, cosine(F.col(vector), query).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def ranked(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, rank from 1) of a list that a limit has bounded."""
    return df.select(key, F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank"))


def fuse(lexical: DataFrame, dense: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(key, score) by reciprocal ranks of two bounded lists of (key, rank)."""
    both = lexical.select(key, "rank", F.lit(1).alias("lex")).unionByName(dense.select(key, "rank", F.lit(0).alias("lex")))
    fused = both.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.when(F.col("lex") == 1, F.col("rank"))).alias("lexical_rank"))
    return fused


def fused_order() -> list[Column]:
    """Best first; ties keep the lexical order, then rows that only the retriever found."""
    return [F.desc("score"), F.asc_nulls_last("lexical_rank")]


def search(
    lexical: DataFrame,
    rows: DataFrame,
    key: str,
    score: str,
    retriever: Callable[[int], DataFrame],
    fusion: Callable[[DataFrame, DataFrame, str], DataFrame] = fuse,
    top: int = TOP,
) -> DataFrame:
    """(key, score, lexical_rank) of a lexical list fused with what a retriever finds.

    ``lexical`` are the scored matches, ``rows`` the table's rows, both by the request's conditions and the viewer's row
    rules: what the retriever alone found must be among ``rows``. The retriever gets ``top`` and gives (key, score), of
    which the best ``top`` count. If it fails the lexical order stands; if the fusion fails ranks are fused as by
    default; a warning says why.
    """
    spark = lexical.sparkSession
    own = numbered(lexical.select(key, score), [F.desc(score), F.asc(key)], "rank").select(key, "rank")
    kind = f"`{key}` {lexical.schema[key].dataType.simpleString()}, score double"
    found: list = []
    try:
        best = retriever(top).select(key, F.col("score").cast("double").alias("score")).where("score is not null")
        found = best.orderBy(F.desc("score"), key).limit(top).collect()  # ``top`` rows at most
    except _HOOK_ERRORS as e:
        warnings.warn(f"the retriever failed, the lexical order stands: {e}", stacklevel=2)
    dense = ranked(spark.createDataFrame(found, kind), key, "score")
    try:
        fused = fusion(own, dense, key).select(key, "score", "lexical_rank")
    except _HOOK_ERRORS as e:
        warnings.warn(f"the fusion failed, ranks are fused by default: {e}", stacklevel=2)
        fused = fuse(own, dense, key)
    return fused.join(rows.select(key), key, "left_semi")


def rerank(scored: DataFrame, key: str, score: str, hook: Callable[[DataFrame], DataFrame], top: int = TOP) -> DataFrame:
    """(key, position): the hook orders the top rows, the others follow in their order.

    ``hook`` gets the top rows and returns (key, rank). Rows that it invents are dropped, rows that it leaves out come
    after those it named. If it fails - its plan or its run, which is done here over the ``top`` rows - the order stands as
    it was, and a warning says why.
    """
    head = scored.orderBy(F.desc(score), key).limit(top)
    inside = head.select(key).withColumn("_in", F.lit(True))
    named = head.select(key, F.lit(None).cast("int").alias("_rank"))
    try:
        order = hook(head).select(key, F.col("rank").cast("int").alias("_rank")).join(F.broadcast(inside.drop("_in")), key, "left_semi")
        rows = order.groupBy(key).agg(F.min("_rank").alias("_rank")).collect()  # ``top`` rows at most
        named = scored.sparkSession.createDataFrame(rows, named.schema)
    except _HOOK_ERRORS as e:
        warnings.warn(f"the reranker failed, its rows keep their order: {e}", stacklevel=2)
    joined = scored.join(F.broadcast(inside), key, "left").join(F.broadcast(named.join(inside.drop("_in"), key, "left_semi")), key, "left")
    order = [F.desc_nulls_last("_in"), F.asc_nulls_last("_rank"), F.desc(score), F.asc(key)]
    return numbered(joined, order, "position").select(key, "position")
