"""A corpus pipeline of five operators; each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id
from rivulet.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose n-grams rank less like any language than this are rejected, if they have ``LEAST_LETTERS``. Uniform a-z (with
#: spaces or not), base64, hex and printable noise of 200 letters to 100,000 characters scores at most 0.22; runs of 1 to 40 words
#: of clean documents score 0.37 at least, whole documents (sf0.1, check_s) 0.38.
LEAST_SCORE = 0.30
#: Of fewer letters noise scores up to 0.67, as clean words do, so the score says nothing.
LEAST_LETTERS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict_language(docs.select(COLUMNS), profiles)
    letters = F.length(F.regexp_replace("doc.text", r"\P{L}+", ""))
    return found.where((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SCORE) | (letters < LEAST_LETTERS))).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs.select(COLUMNS), keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the least id, nulls last; among rows of equal ids any one of them.

    Classes are found over a key of the rows, written with them, so null and repeated ids are documents like others."""
    keyed = materialize(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-keys")
    classes = jaccard_join.jaccard_classes(keyed, id_col="row").select("row", "class_id")
    ranked = keyed.select("row", "doc_id").join(classes, "row").withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = ranked.groupBy("class_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return keyed.join(kept, "row", "left_semi").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select("doc.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

#: Rank-order profiles, MinHash classes and BPE merges are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
