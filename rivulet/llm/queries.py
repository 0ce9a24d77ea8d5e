"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import byte_bpe, chat_format, decontaminate, exact_dedup, jaccard_join, language_id, suffix_dedup, token_counts, token_output, url_filter
from rivulet.llm.common import shared_dir

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
END_ID, TOKEN_LIMIT = 2, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark).rstrip('/')}/rivulet/token-output-{uuid.uuid4().hex}"
    token_output.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_output.read_digests(spark, out)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_digests(turns.unionByName(extra))


def chat_digests(turns: DataFrame) -> DataFrame:
    read = chat_format.read_windows(chat_format.format_windows(turns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.select(
        "conv_id",
        F.struct("window", F.array_join(line, "").alias("lines"), F.array_join("targets", "").alias("loss"), F.size("turns").alias("n"), "n_chars").alias("w"),
    )
    conv = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda c: F.aggregate(F.col(f"w.{c}"), F.lit(0).cast("long"), lambda a, x: a + x)
    loss = F.array_join("w.loss", "")
    return conv.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join("w.lines", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        total("n_chars").alias("formatted_chars"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page.page_id", "host", "path", "rule", "verdict", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict_language(docs.select("doc_id", "text"), profiles, carry=["doc_id"])
    return found.select("doc.doc_id", language_id.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_jaccard_join,
        op3_token_output,
        op4_exact_dedup,
        op5_token_counts,
        op6_byte_bpe,
        op7_chat_format,
        op8_decontaminate,
        op9_url_filter,
        op10_language_id,
    )
}

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '<', '\l'), '#', '\h')"
_BUDGET, _HISTORY = chat_format.BUDGET, chat_format.HISTORY

ORACLES = {
    "op7_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        numbered AS (
            SELECT *, ceil(strlen(text) / 4.0) + 4 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns),
        placed AS (
            SELECT *, n = 1 AND role = 'system' AS sys,
                   coalesce(sum(CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                   coalesce(max(CASE WHEN n = 1 AND role = 'system' THEN cost END) OVER (PARTITION BY conv_id), 0) AS sys_cost FROM numbered),
        spans AS (
            SELECT *, {_BUDGET} - sys_cost - {_HISTORY} AS room, coalesce(max(CASE WHEN NOT sys THEN cost END) OVER (PARTITION BY conv_id), 0) AS dearest FROM placed),
        cells AS (
            SELECT *, CASE WHEN sys THEN 0 ELSE floor(start / greatest(1, CASE WHEN dearest < room THEN room - dearest + 1 ELSE floor(room / 2) END)) END AS cell FROM spans),
        opened AS (SELECT *, coalesce(lag(cell) OVER (PARTITION BY conv_id ORDER BY n) <> cell, true) AS opens FROM cells),
        windows AS (
            SELECT *, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY conv_id) - 1 AS last_window,
                   first_value(CASE WHEN opens THEN start END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start
            FROM opened),
        sized AS (
            SELECT *, 1 + CASE WHEN sys THEN last_window WHEN start >= next_start - {_HISTORY} THEN 1 ELSE 0 END AS copies,
                   14 + length(replace({_ESCAPED.format("role")}, ':', '\c')) + length({_ESCAPED.format("text")}) AS size FROM windows)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(copies * size) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_decontaminate": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        phrase AS (
            SELECT DISTINCT item, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS p
            FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM iw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM phrase),
        grams AS (
            SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS p
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, s, phrase.n AS n, item FROM grams JOIN phrase USING (p)),
        hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
