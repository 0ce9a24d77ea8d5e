"""The registered queries, each with the SQL that gives the same rows.

Names follow the operators they show. Doubles that are summed are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions import values as VF
from rivulet.operators import changes as CH
from rivulet.operators import constraints as CO
from rivulet.operators import fulltext as FT
from rivulet.operators import governance as GO
from rivulet.operators import graph as GR
from rivulet.operators import hybrid as HY
from rivulet.operators import spatial as SP
from rivulet.operators import views as VI
from rivulet.operators import txn as TX
from rivulet.operators.select import Between, Cmp, Eq, In, Match, Order, Radius, Region, Select, compile_select, lookup
from rivulet.plans import specs as S
from rivulet.schema import Catalog, Index, TableSpec, migrate, with_columns
from rivulet.schema import Column as ColumnSpec
from rivulet.sources import catalog as catalog_rows
from rivulet.sources.shared import shared_dir
from rivulet.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read(self.spark, f"{self.sf_dir}/{name}.parquet")


def selects(name: str, select: Select, spec: TableSpec, sql: str) -> None:
    """Register a request of the closed read surface."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_select(select, spec).apply(getattr(Tables(spark, sf_dir), spec.name))

    query(sql, name)(run)


# Scans, filters, order, pages

selects("scan_full", Select("orders"), S.ORDERS, "SELECT * FROM orders")
selects("filter_eq", Select("orders", (Eq("o_orderstatus", "F"),)), S.ORDERS, "SELECT * FROM orders WHERE o_orderstatus = 'F'")
selects("filter_in", Select("orders", (In("o_orderpriority", ("1-URGENT", "5-LOW")),)), S.ORDERS, "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
selects("filter_in_many", Select("part", (In("p_partkey", tuple(range(0, 900, 3))),)), S.PART, "SELECT * FROM part WHERE p_partkey < 900 AND p_partkey % 3 = 0")
selects("filter_between", Select("lineitem", (Between("l_quantity", 10, 20),)), S.LINEITEM, "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
selects("filter_between_inverted", Select("lineitem", (Between("l_quantity", 20, 10),)), S.LINEITEM, "SELECT * FROM lineitem WHERE l_quantity BETWEEN 20 AND 10")
selects("filter_cmp", Select("customer", (Cmp("c_acctbal", "<", 0.0),)), S.CUSTOMER, "SELECT * FROM customer WHERE c_acctbal < 0")
selects(
    "filter_conj",
    Select("lineitem", (Eq("l_returnflag", "R"), Cmp("l_discount", ">=", 0.05), Cmp("l_quantity", "<=", 25), Cmp("l_tax", ">", 0.02))),
    S.LINEITEM,
    "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 AND l_quantity <= 25 AND l_tax > 0.02",
)
selects(
    "filter_timestamp_micros",
    Select("events", (Cmp("ts", ">=", 1_705_276_800_000_000),)),
    S.EVENTS,
    "SELECT * FROM events WHERE ts >= make_timestamp(1705276800000000)",
)
selects(
    "index_prefix_range",
    Select("part", (Eq("p_brand", "Brand#11"), Between("p_size", 5, 30))),
    S.PART,
    "SELECT * FROM part WHERE p_brand = 'Brand#11' AND p_size BETWEEN 5 AND 30",
)
selects(
    "order_limit",
    Select("orders", (Eq("o_orderstatus", "F"), Between("o_totalprice", 1000, 50000)), order=Order("o_totalprice", True), limit=20),
    S.ORDERS,
    "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20",
)
selects("order_limit_ties", Select("part", order=Order("p_size"), limit=50), S.PART, "SELECT * FROM part ORDER BY p_size, p_partkey LIMIT 50")
selects("order_limit_desc_tiebreak", Select("part", order=Order("p_size", True), limit=50), S.PART, "SELECT * FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 50")
selects("limit_zero", Select("part", order=Order("p_size"), limit=0), S.PART, "SELECT * FROM part LIMIT 0")
selects(
    "keyset_asc",
    Select("part", order=Order("p_size"), limit=25, after=(10, 100)),
    S.PART,
    "SELECT * FROM part WHERE p_size > 10 OR (p_size = 10 AND p_partkey > 100) ORDER BY p_size, p_partkey LIMIT 25",
)
selects(
    "keyset_desc",
    Select("part", order=Order("p_size", True), limit=25, after=(40, 500)),
    S.PART,
    "SELECT * FROM part WHERE p_size < 40 OR (p_size = 40 AND p_partkey < 500) ORDER BY p_size DESC, p_partkey DESC LIMIT 25",
)


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup_pk(spark, d):
    return lookup(Tables(spark, d).orders, S.ORDERS, (7,))


@query("SELECT * FROM conversations WHERE conv_id = 3 AND turn = 1")
def composite_pk_lookup(spark, d):
    return lookup(Tables(spark, d).conversations, S.CONVERSATIONS, (3, 1))


# Spatial

POINTS = TableSpec("points", (ColumnSpec("id", "id"), ColumnSpec("x", "f64"), ColumnSpec("y", "f64")), ("id",), indexes=(Index("quadtree", ("x", "y")),)).validate()
BOXES = TableSpec(
    "boxes",
    (ColumnSpec("id", "id"), *(ColumnSpec(c, "f64") for c in ("min_x", "min_y", "max_x", "max_y"))),
    ("id",),
    indexes=(Index("rtree", ("min_x", "min_y", "max_x", "max_y")),),
).validate()


def points(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))


def boxes(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("id"),
        size.cast("double").alias("min_x"),
        (k % 100).cast("double").alias("min_y"),
        (size + k % 7).cast("double").alias("max_x"),
        (k % 100 + k % 11).cast("double").alias("max_y"),
    )


_POINTS = "(SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y FROM customer)"
_BOXES = """(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS min_x, CAST(p_partkey % 100 AS DOUBLE) AS min_y,
    CAST(p_size + p_partkey % 7 AS DOUBLE) AS max_x, CAST(p_partkey % 100 + p_partkey % 11 AS DOUBLE) AS max_y FROM part)"""


def spatial(name: str, clause, spec: TableSpec, source, sql: str) -> None:
    query(sql, name)(lambda spark, d: compile_select(Select(spec.name, spatial=clause), spec).apply(source(Tables(spark, d))))


spatial("spatial_region", Region(0, 100, 3000, 400), POINTS, points, f"SELECT * FROM {_POINTS} WHERE x BETWEEN 0 AND 3000 AND y BETWEEN 100 AND 500")
spatial("spatial_region_empty", Region(0, 100, -1, 400), POINTS, points, f"SELECT * FROM {_POINTS} WHERE false")
spatial("spatial_radius", Radius(900, 4000, 500), POINTS, points, f"SELECT * FROM {_POINTS} WHERE (x - 4000) * (x - 4000) + (y - 500) * (y - 500) <= 810000")
spatial("spatial_box_region", Region(10, 20, 5, 10), BOXES, boxes, f"SELECT * FROM {_BOXES} WHERE min_x <= 15 AND max_x >= 10 AND min_y <= 30 AND max_y >= 20")
spatial(
    "spatial_box_radius",
    Radius(6, 25, 50),
    BOXES,
    boxes,
    f"""SELECT * FROM {_BOXES} WHERE greatest(min_x - 25, 0, 25 - max_x) * greatest(min_x - 25, 0, 25 - max_x)
        + greatest(min_y - 50, 0, 50 - max_y) * greatest(min_y - 50, 0, 50 - max_y) <= 36""",
)


@query("SELECT c_custkey AS id, CAST(c_custkey % 30 AS DOUBLE) AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y FROM customer WHERE c_custkey % 1000 = 77 AND c_custkey % 30 = 17")
def spatial_point(spark, d):
    grid = points(Tables(spark, d)).withColumn("x", (F.col("id") % 30).cast("double"))
    return grid.where(SP.point_at(F.col("x"), F.col("y"), 17.0, 77.0))


@query(f"SELECT * FROM {_BOXES} WHERE min_x <= 12 AND max_x >= 12 AND min_y <= 33 AND max_y >= 33")
def spatial_box_point(spark, d):
    return boxes(Tables(spark, d)).where(SP.box_holds(tuple(map(F.col, BOXES.indexes[0].columns)), 12.0, 33.0))


# Views


def view(name: str, v: VI.MatView, sql: str, digits: int | None = None) -> None:
    def run(spark, d):
        out = VI.compute(v, getattr(Tables(spark, d), v.table))
        return out.withColumn("value", F.round(F.col("value").cast("double"), digits)) if digits is not None else out

    query(sql, name)(run)


V_COUNT = VI.MatView("v", "events", "count", group_by="event_type")
V_SUM = VI.MatView("v", "events", "sum", "value", "event_type")
V_MAX = VI.MatView("v", "events", "max", "value", "event_type")
V_MIN = VI.MatView("v", "events", "min", "value", "event_type")
V_AVG = VI.MatView("v", "events", "avg", "value", "event_type")
V_TOP = VI.MatView("v", "orders", order_by="o_totalprice", limit=25, key="o_orderkey")
view("view_count_by", V_COUNT, 'SELECT event_type AS "group", count(*) AS value FROM events GROUP BY 1')
view("view_sum_by", V_SUM, 'SELECT event_type AS "group", round(sum(value), 6) AS value FROM events GROUP BY 1', 6)
view("view_sum_int", VI.MatView("v", "part", "sum", "p_size", "p_brand"), 'SELECT p_brand AS "group", CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY 1', 0)
view("view_avg_by", V_AVG, 'SELECT event_type AS "group", round(avg(value), 6) AS value FROM events GROUP BY 1', 6)
view("view_min_by", V_MIN, 'SELECT event_type AS "group", min(value) AS value FROM events GROUP BY 1')
view("view_max_by", V_MAX, 'SELECT event_type AS "group", max(value) AS value FROM events GROUP BY 1')
view("view_global_avg", VI.MatView("v", "orders", "avg", "o_totalprice"), "SELECT '*' AS \"group\", round(avg(o_totalprice), 4) AS value FROM orders", 4)
view("view_topn", V_TOP, "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice AS value, o_orderkey AS key FROM orders ORDER BY 1 LIMIT 25")
view(
    "view_topn_asc",
    VI.MatView("v", "orders", order_by="o_totalprice", desc=False, limit=10, key="o_orderkey"),
    "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, o_totalprice AS value, o_orderkey AS key FROM orders ORDER BY 1 LIMIT 10",
)


@query("SELECT '*' AS \"group\", count(*) AS value FROM events WHERE value < 0 GROUP BY 1")
def view_empty_global(spark, d):
    return VI.compute(VI.MatView("v", "events", "count"), Tables(spark, d).events.where("value < 0"))


def _event_batches(t: Tables):
    """A base table, then a batch that deletes some rows and adds others."""
    e = t.events
    return e.where("event_id % 3 != 0"), e.where("event_id % 3 = 0"), e.where("event_id % 5 = 1 and event_id % 3 != 0")


_AFTER = "(SELECT * FROM events WHERE NOT (event_id % 5 = 1 AND event_id % 3 <> 0))"


def incremental(name: str, v: VI.MatView, sql: str, digits: int | None = None) -> None:
    def run(spark, d):
        base, come, gone = _event_batches(Tables(spark, d))
        out = VI.read_state(v, VI.merge_state(v, VI.state_of(v, base), VI.signed(come, gone)))
        return out.withColumn("value", F.round(F.col("value").cast("double"), digits)) if digits is not None else out

    query(sql, name)(run)


incremental("view_count_incremental", V_COUNT, f'SELECT event_type AS "group", count(*) AS value FROM {_AFTER} GROUP BY 1')
incremental("view_sum_incremental", V_SUM, f'SELECT event_type AS "group", round(sum(value), 6) AS value FROM {_AFTER} GROUP BY 1', 6)
incremental("view_avg_incremental", V_AVG, f'SELECT event_type AS "group", round(avg(value), 6) AS value FROM {_AFTER} GROUP BY 1', 6)
incremental("view_min_incremental", V_MIN, f'SELECT event_type AS "group", min(value) AS value FROM {_AFTER} GROUP BY 1')
incremental("view_max_incremental", V_MAX, f'SELECT event_type AS "group", max(value) AS value FROM {_AFTER} GROUP BY 1')
incremental(
    "view_topn_incremental",
    VI.MatView("v", "events", order_by="value", limit=20, key="event_id"),
    f"SELECT row_number() OVER (ORDER BY value DESC, event_id) AS rank, value, event_id AS key FROM {_AFTER} ORDER BY 1 LIMIT 20",
)


@query(
    f"""WITH a AS (SELECT event_type AS g, max(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
        b AS (SELECT event_type AS g, max(value) AS v FROM {_AFTER} GROUP BY 1)
        SELECT CASE WHEN a.g IS NULL THEN 'insert' WHEN b.g IS NULL THEN 'delete' ELSE 'update' END AS op,
               coalesce(a.g, b.g) AS "group", a.v AS old_value, b.v AS new_value
        FROM a FULL JOIN b ON a.g = b.g WHERE a.v IS DISTINCT FROM b.v"""
)
def view_delta_changed_keys(spark, d):
    base, come, gone = _event_batches(Tables(spark, d))
    old = VI.state_of(V_MAX, base)
    new = VI.merge_state(V_MAX, old, VI.signed(come, gone))
    out = VI.view_delta(V_MAX, VI.read_state(V_MAX, old), VI.read_state(V_MAX, new))
    return out.select("op", "group", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS pending FROM events")
def row_counts(spark, d):
    return Tables(spark, d).events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("pending"))


# Full text

SIMPLE = FT.Analyzer(token=FT.PORTABLE_TOKEN)
ENGLISH = FT.Analyzer("english", True, True, FT.PORTABLE_TOKEN)
_STOPS = ", ".join(f"'{w}'" for w in FT.STOP_WORDS)
_WORDS = r"""words AS (SELECT doc_id, pos - 1 AS pos, lower(w[pos]) AS term FROM
    (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+') AS w FROM documents)))"""
_STEM = """CASE WHEN term LIKE '%ies' AND strlen(term) >= 5 THEN left(term, length(term) - 3) || 'y'
    WHEN term LIKE '%sses' AND strlen(term) >= 6 THEN left(term, length(term) - 2)
    WHEN term LIKE '%ing' AND strlen(term) >= 7 THEN left(term, length(term) - 3)
    WHEN term LIKE '%edly' AND strlen(term) >= 7 THEN left(term, length(term) - 4)
    WHEN term LIKE '%ed' AND strlen(term) >= 5 THEN left(term, length(term) - 2)
    WHEN term LIKE '%ly' AND strlen(term) >= 5 THEN left(term, length(term) - 2)
    WHEN term LIKE '%es' AND strlen(term) >= 5 THEN left(term, length(term) - 2)
    WHEN term LIKE '%s' AND term NOT LIKE '%ss' AND strlen(term) > 3 THEN left(term, length(term) - 1) ELSE term END"""


@query(f"WITH {_WORDS} SELECT term, count(*) AS n FROM words GROUP BY term")
def fts_tokens(spark, d):
    post = FT.postings(Tables(spark, d).documents, "doc_id", "text", SIMPLE)
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_WORDS} SELECT {_STEM} AS term, count(*) AS n, sum(pos) AS places FROM words WHERE term NOT IN ({_STOPS}) GROUP BY 1")
def fts_stems(spark, d):
    post = FT.postings(Tables(spark, d).documents, "doc_id", "text", ENGLISH)
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query(f"WITH {_WORDS} SELECT doc_id, term, pos FROM words")
def fts_postings(spark, d):
    return FT.postings(Tables(spark, d).documents, "doc_id", "text", SIMPLE)


@query(f"WITH {_WORDS} SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM words GROUP BY ALL")
def fts_postings_full(spark, d):
    """The postings as one row for a document and term."""
    return FT.term_counts(Tables(spark, d).documents, "doc_id", "text", SIMPLE)


@query(
    f"""WITH {_WORDS}, dl AS (SELECT d.doc_id, count(w.term) AS dl FROM documents d LEFT JOIN words w USING (doc_id) GROUP BY 1)
        SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_len, (SELECT count(DISTINCT doc_id) FROM words WHERE term = 'the') AS df_the FROM dl"""
)
def fts_corpus_stats(spark, d):
    docs = Tables(spark, d).documents
    stats = FT.corpus_stats(FT.document_lengths(docs, "doc_id", "text", SIMPLE))
    df = FT.postings(docs, "doc_id", "text", SIMPLE).where("term = 'the'").agg(F.countDistinct("doc_id").alias("df_the"))
    return stats.crossJoin(F.broadcast(df)).withColumn("avg_len", F.round("avg_len", 6))  # one row each


def _found(df: DataFrame) -> DataFrame:
    return df.select("doc_id")


@query(f"WITH {_WORDS} SELECT doc_id FROM words WHERE term IN ('the', 'and') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def fts_match_and(spark, d):
    return _found(FT.bm25(Tables(spark, d).documents, "doc_id", "text", "the and", SIMPLE))


@query(f"WITH {_WORDS} SELECT DISTINCT doc_id FROM words WHERE term LIKE 'erth%'")
def fts_match_prefix(spark, d):
    return _found(FT.bm25(Tables(spark, d).documents, "doc_id", "text", "erth*", SIMPLE))


_PHRASE = "SELECT a.doc_id, count(*) AS tf FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1"


@query(f"WITH {_WORDS} SELECT doc_id FROM ({_PHRASE})")
def fts_match_phrase(spark, d):
    return _found(FT.bm25(Tables(spark, d).documents, "doc_id", "text", '"of the"', SIMPLE))


@query(f"WITH {_WORDS} SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500 AND doc_id IN (SELECT doc_id FROM words WHERE term = 'with')")
def fts_match_filtered(spark, d):
    docs = Tables(spark, d).documents
    return docs.where((F.col("lang") == "en") & (F.col("n_chars") > 500) & FT.matches(F.col("text"), "with", SIMPLE)).select("doc_id")


@query(f"WITH {_WORDS} SELECT doc_id FROM ({_PHRASE}) JOIN (SELECT DISTINCT doc_id FROM words WHERE term LIKE 'an%') USING (doc_id)")
def fts_live_boolean(spark, d):
    return Tables(spark, d).documents.where(FT.matches(F.col("text"), '"of the" an*', SIMPLE)).select("doc_id")


_BM25 = f"""{_WORDS}, dl AS (SELECT d.doc_id, count(w.term) AS dl FROM documents d LEFT JOIN words w USING (doc_id) GROUP BY 1),
    st AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS avgdl FROM dl),
    tf AS (SELECT doc_id, 0 AS item, count(*) AS tf FROM words WHERE term = 'the' GROUP BY 1
        UNION ALL SELECT doc_id, 1, count(*) FROM words WHERE term LIKE 'er%' GROUP BY 1 UNION ALL SELECT doc_id, 2, tf FROM ({_PHRASE})),
    df AS (SELECT item, count(*) AS df FROM tf GROUP BY 1),
    scored AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM tf JOIN df USING (item) JOIN dl USING (doc_id), st GROUP BY 1 HAVING count(*) = 3)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored")
def fts_bm25(spark, d):
    out = FT.bm25(Tables(spark, d).documents, "doc_id", "text", 'the er* "of the"', SIMPLE)
    return out.select("doc_id", F.round("_score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def fts_bm25_topk(spark, d):
    out = FT.bm25(Tables(spark, d).documents, "doc_id", "text", 'the er* "of the"', SIMPLE)
    return out.orderBy(F.desc("_score"), "doc_id").limit(10).select("doc_id", F.round("_score", 6).alias("score"))


# The same by the analyzer that declared indexes use, whose words end where the script says (combining vowels are part of them),
# and by stored postings.


@query(f"WITH {_WORDS} SELECT doc_id FROM words WHERE term IN ('the', 'and') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def fts_match_default_analyzer(spark, d):
    return compile_select(Select("documents", (Match("text", "The and"),)), S.DOCUMENTS).apply(Tables(spark, d).documents).select("doc_id")


@query(
    """WITH d(doc_id, w) AS (VALUES (1, ['हिन्दी', 'भाषा', 'में']), (2, ['ภาษาไทย']), (3, ['العربيّة', 'لغة']), (4, ['हिन्दी']))
       SELECT CAST(doc_id AS BIGINT) AS doc_id, 'हिन्दी' AS query FROM d WHERE list_contains(w, 'हिन्दी') UNION ALL SELECT doc_id, 'العربيّة' FROM d WHERE list_contains(w, 'العربيّة')
       UNION ALL SELECT doc_id, 'ภาษาไทย' FROM d WHERE list_contains(w, 'ภาษาไทย')"""
)
def fts_match_scripts(spark, d):
    """Words with combining vowels are found by themselves."""
    df = spark.createDataFrame([(1, "हिन्दी भाषा में"), (2, "ภาษาไทย"), (3, "العربيّة لغة"), (4, "(हिन्दी)")], "doc_id long, text string")
    parts = [df.where(FT.matches(F.col("text"), w, FT.Analyzer())).select("doc_id", F.lit(w).alias("query")) for w in ("हिन्दी", "العربيّة", "ภาษาไทย")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _stored(spark, d) -> FT.StoredIndex:
    path = f"{shared_dir(spark).rstrip('/')}/rivulet/fulltext-{uuid.uuid4().hex}"
    return FT.StoredIndex.write(Tables(spark, d).documents, "doc_id", "text", SIMPLE, path)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored")
def fts_bm25_stored(spark, d):
    out = _stored(spark, d).scores("doc_id", 'the er* "of the"', SIMPLE)
    return out.select("doc_id", F.round("_score", 6).alias("score"))


@query(f"WITH {_WORDS} SELECT doc_id, lang FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM words WHERE term = 'with')")
def fts_select_stored(spark, d):
    plan = compile_select(Select("documents", (Match("text", "with"), Eq("lang", "en"))), S.DOCUMENTS)
    return plan.apply(Tables(spark, d).documents, index=_stored(spark, d)).select("doc_id", "lang")


# Dense and hybrid

#: The stated query vector: 64 numbers from a rule.
VECTOR = [((7 * k) % 13 - 6) / 6 for k in range(64)]
_VEC = "[" + ", ".join(f"{v!r}::DOUBLE" for v in VECTOR) + "]"
_COS = f"SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_VEC}) AS s FROM embeddings"


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_COS}) ORDER BY s DESC, vec_id LIMIT 20")
def vector_topk(spark, d):
    out = HY.vector_topk(Tables(spark, d).embeddings, "vec_id", "embedding", VECTOR, 20)
    return out.select("vec_id", F.round("score", 6).alias("score"))


def _fused(t: Tables) -> DataFrame:
    lexical = FT.bm25(t.documents, "doc_id", "text", 'the er* "of the"', SIMPLE).orderBy(F.desc("_score"), "doc_id").limit(HY.TOP)
    dense = HY.vector_topk(t.embeddings, "vec_id", "embedding", VECTOR).withColumnRenamed("vec_id", "doc_id")
    return HY.fuse(HY.ranked(lexical, "doc_id", "_score"), HY.ranked(dense, "doc_id", "score"), "doc_id")


_RRF = f"""{_BM25}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored QUALIFY r <= 100),
    den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM ({_COS}) QUALIFY r <= 100),
    fused AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score, min(lr) AS lexical_rank FROM
        (SELECT doc_id, r, r AS lr FROM lex UNION ALL SELECT doc_id, r, NULL FROM den) GROUP BY 1)"""


@query(f"WITH {_RRF} SELECT doc_id, round(score, 9) AS score, lexical_rank FROM fused")
def hybrid_rrf(spark, d):
    return _fused(Tables(spark, d)).select("doc_id", F.round("score", 9).alias("score"), "lexical_rank")


@query(
    f"""WITH {_RRF}, top AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM fused),
        named AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM top WHERE r <= 20)
        SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN r <= 20 THEN 0 ELSE 1 END, k, score DESC, doc_id) AS position FROM top LEFT JOIN named USING (doc_id)"""
)
def rerank_topk(spark, d):
    """A stand-in hook that orders the top rows by id."""
    hook = lambda head: head.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("rank"))
    return HY.rerank(_fused(Tables(spark, d)), "doc_id", "score", hook, 20)


# Governance


@query("SELECT * FROM orders WHERE o_custkey = 37")
def rls_owner_only(spark, d):
    return GO.visible_rows(Tables(spark, d).orders, S.ORDERS, GO.Viewer("37"))


@query("SELECT * FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 5)")
def rls_member_of(spark, d):
    t = Tables(spark, d)
    return GO.visible_rows(t.supplier, S.SUPPLIER, GO.Viewer("5"), t.customer)


@query("SELECT * FROM orders")
def rls_server_peer(spark, d):
    return GO.visible_rows(Tables(spark, d).orders, S.ORDERS, GO.Viewer("x", is_peer=True))


@query("SELECT * FROM orders WHERE o_custkey = 37 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5")
def rls_topn_full_page(spark, d):
    rows = GO.visible_rows(Tables(spark, d).orders, S.ORDERS, GO.Viewer("37"))
    return compile_select(Select("orders", order=Order("o_totalprice", True), limit=5), S.ORDERS).apply(rows)


def _masking(**masks) -> TableSpec:
    columns = tuple(replace(c, **masks[c.name]) if c.name in masks else c for c in S.CUSTOMER.columns)
    return with_columns(S.CUSTOMER, columns=columns, owner="c_custkey").validate()


@query("SELECT c_custkey, '' AS c_name, c_nationkey, CAST(0 AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def mask_redact(spark, d):
    spec = _masking(c_name={"mask": "redact", "grant": "role:support"}, c_acctbal={"mask": "redact", "grant": "role:support"})
    return GO.project(Tables(spark, d).customer, spec, GO.Viewer("1"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 9 THEN c_name ELSE sha256(c_name) END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mask_hash(spark, d):
    return GO.project(Tables(spark, d).customer, _masking(c_name={"mask": "hash", "grant": "owner"}), GO.Viewer("9"))


@query("SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, '' AS c_mktsegment FROM customer")
def mask_null(spark, d):
    spec = _masking(c_acctbal={"mask": "null", "nullable": True, "grant": "role:bank"}, c_mktsegment={"mask": "null", "grant": "role:bank"})
    return GO.project(Tables(spark, d).customer, spec, GO.Viewer("1"))


@query("SELECT * FROM customer")
def mask_role_grant(spark, d):
    spec = _masking(c_name={"mask": "redact", "grant": "role:support"})
    return GO.project(Tables(spark, d).customer, spec, GO.Viewer("1", frozenset({"support"})))


@query("SELECT c_custkey, c_name, true AS verified FROM customer")
def seal_sign_roundtrip(spark, d):
    key = "00112233445566778899aabbccddeeff"
    sealed = Tables(spark, d).customer.select("c_custkey", GO.seal(F.col("c_name"), key, "customer").alias("c"), GO.sign(F.col("c_name"), key).alias("s"))
    name = GO.open_sealed(F.col("c"), key, "customer")
    return sealed.select("c_custkey", name.alias("c_name"), GO.verify(name, F.col("s"), key).alias("verified"))


# Values


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS amount FROM orders")
def normalize_money(spark, d):
    text = F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("000 "))
    return Tables(spark, d).orders.select("o_orderkey", VF.money(text, 2).cast("string").alias("amount"))


@query("SELECT c_custkey, lower(trim(c_name)) AS name FROM customer")
def normalize_string(spark, d):
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return Tables(spark, d).customer.select("c_custkey", VF.normalize_string(padded, None, "lower", True).alias("name"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS sha FROM documents")
def normalize_nfc(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.sha2(VF.normalize_string(F.col("text"), "nfc"), 256).alias("sha"))


@query("SELECT o_orderkey, o_orderkey / 100.0 AS amount FROM orders")
def money_from_minor_units(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", VF.money_from_minor_units(F.col("o_orderkey"), 2).cast("double").alias("amount"))


COMPUTED = TableSpec(
    "lines",
    (
        ColumnSpec("l_orderkey", "id"),
        ColumnSpec("l_linenumber", "i32"),
        ColumnSpec("total", "f64", computed="l_quantity * l_extendedprice"),
        ColumnSpec("net", "f64", computed="total * (1 - l_discount)"),
        ColumnSpec("label", "str", computed="concat('line-', l_orderkey)"),
    ),
    ("l_orderkey", "l_linenumber"),
)


@query(
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS total, round(l_quantity * l_extendedprice * (1 - l_discount), 4) AS net,
       'line-' || l_orderkey AS label FROM lineitem"""
)
def computed_columns(spark, d):
    out = CO.with_computed(Tables(spark, d).lineitem, COMPUTED)
    return out.select("l_orderkey", "l_linenumber", F.round("total", 4).alias("total"), F.round("net", 4).alias("net"), "label")


HOUR = 3_600_000_000


@query(f"SELECT epoch_us(ts) // {HOUR} * {HOUR} AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def time_bucket_agg(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return Tables(spark, d).events.groupBy(VF.time_bucket(us, HOUR).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, CAST(floor((event_id - 5000) * 1000000.0 / {HOUR}) AS BIGINT) AS i FROM events")
def bucket_index(spark, d):
    return Tables(spark, d).events.select("event_id", VF.bucket_index((F.col("event_id") - 5000) * 1_000_000, HOUR).alias("i"))


@query()
def random_numbers(spark, d):
    """Deterministic per transaction; the values are Spark's own hash, so there is no SQL for them."""
    t, s = F.col("event_id"), F.lit(0)
    return Tables(spark, d).events.select("event_id", VF.random_below(t, s, F.lit(1), 6).alias("die"), VF.random_unit(t, s, F.lit(2)).alias("unit"))


@query("SELECT '{\"o_orderkey\":\"' || o_orderkey || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def json_rows(spark, d):
    return Tables(spark, d).orders.select(VF.row_json({"o_orderkey": "id", "o_orderstatus": "str"}).alias("json"))


# Constraints


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_quantity' AS failed FROM lineitem WHERE NOT (l_quantity <= 40)")
def check_violations(spark, d):
    spec = with_columns(S.LINEITEM, columns=tuple(replace(c, check="l_quantity <= 40") if c.name == "l_quantity" else c for c in S.LINEITEM.columns))
    return CO.check_violations(Tables(spark, d).lineitem, spec).withColumn("failed", F.array_join("failed", ","))


@query("SELECT event_id, 'event_type' AS columns FROM events WHERE event_type = 'error'")
def notnull_violations(spark, d):
    rows = Tables(spark, d).events.withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))
    return CO.null_violations(rows, S.EVENTS).withColumn("columns", F.array_join("columns", ","))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return CO.unique_violations(Tables(spark, d).lineitem, ("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_violations(spark, d):
    t = Tables(spark, d)
    return CO.missing_parents(t.orders, "o_custkey", t.customer.where("c_custkey % 10 != 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query(
    """SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def fk_cascade_delete(spark, d):
    t = Tables(spark, d)
    tables = {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}
    return CO.delete_with_actions(tables, S.CATALOG, "customer", t.customer.where("c_custkey % 10 = 0"))["lineitem"]


@query("SELECT DISTINCT n_nationkey FROM nation WHERE n_regionkey = 1")
def fk_restrict(spark, d):
    """What would refuse the deletion of a region."""
    t = Tables(spark, d)
    return CO.children_of(t.nation, "n_regionkey", t.region.where("r_regionkey = 1"), "r_regionkey").select("n_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def fk_set_null(spark, d):
    from rivulet.schema import Catalog, ForeignKey

    t = Tables(spark, d)
    loose = with_columns(S.ORDERS, foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey", "set_null"),))
    tables = {"customer": t.customer, "orders": t.orders}
    catalog = Catalog(S.REGION, S.NATION, S.CUSTOMER, loose)
    return CO.delete_with_actions(tables, catalog, "customer", t.customer.where("c_custkey % 10 = 0"))["orders"]


# Edges


def _edges(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("from"), F.col("o_orderkey").alias("to"))


@query("SELECT o_orderkey AS neighbor FROM orders WHERE o_custkey = 7")
def edge_neighbors(spark, d):
    return GR.neighbors(_edges(Tables(spark, d)), 7)


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def edge_traverse_frontier(spark, d):
    t = Tables(spark, d)
    return GR.step(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), _edges(t))


# Writes


def _writes(t: Tables):
    rows = t.customer.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(1.5))
    new = t.customer.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return rows.unionByName(new), t.customer.where("c_custkey % 11 = 0 and c_custkey % 7 != 0").select("c_custkey")


_UPSERT = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer {where}
    UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0"""


@query("SELECT * FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0")
def insert_rows(spark, d):
    t = Tables(spark, d)
    return CH.insert(t.customer, t.customer.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000), ["c_custkey"])


@query(_UPSERT.format(where=""))
def upsert_rows(spark, d):
    t = Tables(spark, d)
    return CH.upsert(t.customer, _writes(t)[0], ["c_custkey"])


@query(_UPSERT.format(where="WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 7 <> 0)"))
def upsert_overlay(spark, d):
    t = Tables(spark, d)
    return CH.overlay(t.customer, *_writes(t), ["c_custkey"])


@query("SELECT * FROM customer WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 7 <> 0)")
def delete_overlay(spark, d):
    t = Tables(spark, d)
    return CH.delete(t.customer, _writes(t)[1], ["c_custkey"])


@query("SELECT * FROM customer WHERE NOT (c_acctbal < 0)")
def delete_where(spark, d):
    return CH.delete_where(Tables(spark, d).customer, F.col("c_acctbal") < 0)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_acctbal <> 1.5 UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey % 50 = 0")
def upsert_effective(spark, d):
    t = Tables(spark, d)
    return CH.effective(t.customer, _writes(t)[0], ["c_custkey"]).select("c_custkey")


@query(
    """SELECT CASE WHEN c_custkey % 4 = 0 THEN m + row_number() OVER (PARTITION BY c_custkey % 4 = 0 ORDER BY c_custkey) ELSE c_custkey END AS id, c_custkey AS source
       FROM customer, (SELECT max(c_custkey) AS m FROM customer WHERE c_custkey % 4 <> 0)"""
)
def auto_increment(spark, d):
    rows = Tables(spark, d).customer.select(F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("source"))
    return CH.auto_increment(rows, "id", 0, ["source"])


# Change logs: an event is a write of its user's row; errors delete it


def event_log(t: Tables) -> DataFrame:
    after = F.struct("user_id", "value", "event_type")
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    live = F.col("event_type") != "error"
    log = t.events.select(F.col("event_id").alias("tx_id"), "ts", "user_id", "event_id", live.alias("live"), after.alias("row"))
    before = F.lag(F.when(F.col("live"), F.col("row"))).over(by_user)
    log = log.withColumn("before", before).withColumn("after", F.when(F.col("live"), F.col("row")))
    op = F.when(F.col("after").isNull(), "delete").when(F.col("before").isNull(), "insert").otherwise("update")
    return log.select("tx_id", "ts", op.alias("op"), "user_id", "before", "after")


_LOG = """log AS (SELECT event_id AS tx_id, ts, user_id, value, event_type, event_type <> 'error' AS live,
    lag(CASE WHEN event_type <> 'error' THEN value END) OVER w AS old_value, lag(event_type) OVER w AS old_type,
    coalesce(lag(event_type <> 'error') OVER w, false) AS had FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
_LATEST = "SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tx_id DESC) AS r FROM log WHERE {when}) WHERE r = 1 AND live"


@query(f"WITH {_LOG} {_LATEST.format(when='tx_id <= 600')}")
def as_of_tx(spark, d):
    return CH.as_of(event_log(Tables(spark, d)), ["user_id"], tx=600)


_TS = "ts <= TIMESTAMP '2024-01-12 00:00:00'"


@query(f"WITH {_LOG} {_LATEST.format(when=_TS)}")
def as_of_timestamp(spark, d):
    return CH.as_of(event_log(Tables(spark, d)), ["user_id"], ts=F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"))


@query(f"WITH {_LOG} {_LATEST.format(when='true')}")
def replay_log(spark, d):
    return CH.replay(event_log(Tables(spark, d)), ["user_id"])


@query(
    f"""WITH {_LOG} SELECT tx_id, ts, CAST(live AS BIGINT) AS inserted, CAST(NOT live OR had AS BIGINT) AS deleted FROM log
        WHERE user_id = 5 AND tx_id BETWEEN 100 AND 9000 ORDER BY tx_id LIMIT 1000"""
)
def audit_trail(spark, d):
    return CH.audit(event_log(Tables(spark, d)), "user_id", 5, (100, 9000)).drop("caller")


@query(
    f"""WITH {_LOG} SELECT tx_id, CASE WHEN NOT live THEN 'delete' WHEN had THEN 'update' ELSE 'insert' END AS op, user_id,
        CASE WHEN live THEN value END AS value FROM log WHERE tx_id > 500"""
)
def cdc_changes(spark, d):
    return CH.cdc(event_log(Tables(spark, d)), ["user_id"], 500).select("tx_id", "op", "user_id", F.col("row.value").alias("value"))


@query(
    f"""WITH {_LOG}, e AS (SELECT user_id, max(tx_id) AS tx_id, arg_min(CASE WHEN had THEN old_value END, tx_id) AS x,
            bool_or(had) FILTER (WHERE tx_id = lo) AS had, bool_or(live) FILTER (WHERE tx_id = hi) AS live,
            max(old_value) FILTER (WHERE tx_id = lo) AS old_value, max(old_type) FILTER (WHERE tx_id = lo) AS old_type,
            max(value) FILTER (WHERE tx_id = hi) AS value, max(event_type) FILTER (WHERE tx_id = hi) AS event_type
        FROM (SELECT *, min(tx_id) OVER (PARTITION BY user_id) AS lo, max(tx_id) OVER (PARTITION BY user_id) AS hi FROM log WHERE tx_id > 500) GROUP BY user_id)
        SELECT tx_id, user_id, CASE WHEN NOT had THEN 'insert' WHEN NOT live THEN 'delete' ELSE 'update' END AS op FROM e
        WHERE (had OR live) AND NOT (had AND live AND old_value = value AND old_type = event_type)"""
)
def net_changes(spark, d):
    log = event_log(Tables(spark, d)).where("tx_id > 500")
    return CH.net_changes(log, ["user_id"]).select("tx_id", "user_id", "op")


# Live reads

_IN, _WAS = "(live AND value > 50)", "(had AND old_value > 50)"


def _deltas(t: Tables) -> DataFrame:
    return CH.deltas(event_log(t), lambda row: row["value"] > 50, ["user_id"])


@query(f"WITH {_LOG} SELECT tx_id, user_id, value FROM log WHERE {_IN} AND NOT ({_WAS} AND old_value = value AND old_type = event_type)")
def sub_delta_inserts(spark, d):
    return _deltas(Tables(spark, d)).where("op = 'insert'").select("tx_id", "user_id", F.col("row.value").alias("value"))


@query(f"WITH {_LOG} SELECT tx_id, user_id FROM log WHERE {_WAS} AND NOT {_IN}")
def sub_delta_deletes(spark, d):
    return _deltas(Tables(spark, d)).where("op = 'delete'").select("tx_id", "user_id")


@query(f"WITH {_LOG} SELECT tx_id, user_id, CASE WHEN {_IN} THEN 'enters' ELSE 'leaves' END AS transition FROM log WHERE live AND had AND {_IN} <> {_WAS}")
def sub_delta_transition(spark, d):
    log = event_log(Tables(spark, d)).where("op = 'update'")
    now, was = F.col("after.value") > 50, F.col("before.value") > 50
    return log.where(now != was).select("tx_id", "user_id", F.when(now, "enters").otherwise("leaves").alias("transition"))


@query("SELECT 'q' || user_id % 3 || event_type AS query_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def sub_value_prune(spark, d):
    constants = spark.createDataFrame([(f"q{k}{v}", v, k) for k in range(3) for v in ("click", "view")], "query_id string, value string, k long")
    rows = Tables(spark, d).events.select("event_id", "user_id", "event_type")
    hit = CH.stab(rows, "event_type", constants).where(F.col("user_id") % 3 == F.col("k"))
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOG} SELECT tx_id, user_id FROM log WHERE ({_IN} AND NOT ({_WAS} AND old_value = value AND old_type = event_type) OR {_WAS} AND NOT {_IN}) AND tx_id > 900")
def sub_resume_window(spark, d):
    return CH.resume(_deltas(Tables(spark, d)), 900)[0].select("tx_id", "user_id")


@query(
    f"""WITH {_LOG}, d AS (SELECT tx_id FROM log WHERE {_IN} AND NOT ({_WAS} AND old_value = value AND old_type = event_type) OR {_WAS} AND NOT {_IN}),
        w AS (SELECT DISTINCT tx_id FROM d ORDER BY tx_id DESC LIMIT 256)
        SELECT o AS "offset", (SELECT count(*) = 256 AND o < min(tx_id) - 1 FROM w) AS reset FROM (VALUES (3), (CAST(1e15 AS BIGINT))) v(o)"""
)
def sub_resume_reset(spark, d):
    """A reader far behind starts anew, one that saw all does not."""
    found = [(o, bool(CH.resume(_deltas(Tables(spark, d)), o)[1])) for o in (3, 10**15)]
    return spark.createDataFrame(found, "offset long, reset boolean")


@query(f"WITH {_LOG} SELECT count(*) AS n FROM log WHERE NOT (live AND had AND old_type = event_type)")
def sub_masked_suppression(spark, d):
    return CH.masked_changes(event_log(Tables(spark, d)), ["event_type"]).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, count(DISTINCT q) AS refs FROM (SELECT doc_id, 1 AS q FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2 FROM documents WHERE n_chars > 1000
       UNION ALL SELECT doc_id, 3 FROM documents WHERE source = 'src1') GROUP BY 1"""
)
def cache_refcounts(spark, d):
    docs = Tables(spark, d).documents
    parts = [docs.where(p).select(F.lit(k).alias("query_id"), "doc_id") for k, p in enumerate(("lang = 'en'", "n_chars > 1000", "source = 'src1'"))]
    return CH.refcounts(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["doc_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'delete' ELSE 'insert' END AS op FROM customer WHERE c_custkey % 3 <> 1")
def cache_reconcile(spark, d):
    c = Tables(spark, d).customer.select("c_custkey")
    return CH.reconcile(c.where("c_custkey % 3 != 2"), c.where("c_custkey % 3 != 0"))


# Time

_NOW = "2024-01-20 00:00:00"


@query(f"SELECT event_id FROM events WHERE ts <= TIMESTAMP '{_NOW}'")
def ttl_absolute(spark, d):
    return CH.expired(Tables(spark, d).events, "ts", F.lit(_NOW).cast("timestamp_ntz")).select("event_id")


@query(
    f"""WITH {_LOG} SELECT user_id, ts AS last_write FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tx_id DESC) AS r FROM log)
        WHERE r = 1 AND live AND epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts) > 86400000000"""
)
def ttl_sliding(spark, d):
    return CH.idle(event_log(Tables(spark, d)), ["user_id"], F.lit(_NOW).cast("timestamp_ntz"), 86_400_000_000)


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) = 1")
def idempotent_dedup(spark, d):
    calls = Tables(spark, d).events.withColumn("day", F.to_date("ts"))
    return CH.first_submissions(calls, ["user_id", "event_type", "day"], "event_id").select("event_id")


@query(
    """SELECT id, CASE WHEN period_us > 0 THEN CASE WHEN execute_at_us + period_us <= 500000 THEN 500000 + period_us ELSE execute_at_us + period_us END END AS next_us
       FROM (SELECT event_id AS id, event_id * 100 AS execute_at_us, (event_id % 4) * 100000 AS period_us FROM events) WHERE execute_at_us <= 500000"""
)
def schedule_due_next(spark, d):
    e = F.col("event_id")
    rows = Tables(spark, d).events.select(e.alias("id"), (e * 100).alias("execute_at_us"), (e % 4 * 100_000).alias("period_us"))
    return CH.due(rows, 500_000).select("id", "next_us")


@query()
def rate_limit(spark, d):
    """Each refusal depends on those before: there is no SQL for it."""
    calls = Tables(spark, d).events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return CH.token_bucket(calls, "user_id", "at_us", 2, 0.0001)


# Shards, catalog, evolution


@query()
def shard_hash_counts(spark, d):
    """The hash is Spark's own, so there is no SQL for it."""
    return Tables(spark, d).orders.groupBy(SP.hash_shard(F.col("o_custkey"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_custkey >= 1000 THEN 2 WHEN o_custkey >= 500 THEN 1 ELSE 0 END AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_range(spark, d):
    return Tables(spark, d).orders.groupBy(SP.range_shard(F.col("o_custkey"), [100, 500, 1000]).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'hash' AS partitioning, count(*) AS n, count(*) > 0 AS spread FROM orders UNION ALL SELECT 'none', count(*), false FROM orders UNION ALL SELECT 'global', count(*), false FROM orders")
def shard_placement(spark, d):
    """Only tables that are partitioned leave shard 0."""
    orders = Tables(spark, d).orders
    parts = []
    for kind in ("hash", None, "global"):
        shard = SP.placed_shard(kind, F.col("o_custkey"), 8)
        parts.append(orders.agg(F.lit(kind or "none").alias("partitioning"), F.count(F.lit(1)).alias("n"), (F.max(shard) > 0).alias("spread")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""SELECT ((((CAST(floor(y / 100) AS BIGINT) % 4) + 4) % 4) + (((CAST(floor(x / 100) AS BIGINT) % 4) + 4) % 4) * 4) % 6 AS shard, count(*) AS n FROM {_POINTS} GROUP BY 1"""
)
def shard_region(spark, d):
    return points(Tables(spark, d)).groupBy(SP.region_shard(F.col("x"), F.col("y"), 100.0, 4, 6).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('public', '{t.name}', '{t.access}')" for t in S.CATALOG.tables.values()) + ") v(table_schema, table_name, access)")
def catalog_tables(spark, d):
    return catalog_rows.tables(spark, S.CATALOG)


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('public', '{t.name}', '{c.name}', {k}, '{'YES' if c.nullable else 'NO'}', '{c.kind.spark}')" for t in S.CATALOG.tables.values() for k, c in enumerate(t.columns, 1)
    )
    + ") v(table_schema, table_name, column_name, ordinal_position, is_nullable, data_type)"
)
def catalog_columns(spark, d):
    return catalog_rows.columns(spark, S.CATALOG)


@query("SELECT r_regionkey, r_name AS name, 'new' AS note FROM region")
def schema_migration(spark, d):
    new = with_columns(S.REGION, columns=(S.REGION.columns[0], ColumnSpec("name", "str", renamed_from="r_name"), ColumnSpec("note", "str", default="new")))
    return migrate(Tables(spark, d).region, S.REGION, new)


# Transactions, view functions and optimistic layers over customer and orders

_ACCOUNT = TableSpec("account", (ColumnSpec("id", "id"), ColumnSpec("v", "i64")), ("id",))
_NOTES = TableSpec("notes", (ColumnSpec("id", "id"), ColumnSpec("event", "str")), ("id",))
_BOOKS = Catalog(_ACCOUNT, _NOTES)


def _books(spark, d) -> dict[str, DataFrame]:
    accounts = Tables(spark, d).customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("long").alias("v"))
    return {"account": accounts, "notes": spark.createDataFrame([], "id long, event string")}


@query(
    """SELECT c_custkey AS id, 'update' AS event FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'delete' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0
       UNION ALL SELECT c_custkey + 1000000, 'insert' FROM customer WHERE c_custkey % 11 = 0"""
)
def txn_trigger_events(spark, d):
    """Triggers are told what came, changed and went, and what they write is part of the transaction."""

    def procedure(t):
        old = t.snapshot("account")
        t.delete("account", old.where("id % 7 = 0 and id % 5 <> 0"))
        t.upsert("account", old.where("id % 5 = 0").select("id", (F.col("v") + 1).alias("v")))
        t.insert("account", old.where("id % 11 = 0").select((F.col("id") + 1000000).alias("id"), "v"))

    trigger = lambda event, rows: {"notes": rows.select("id", F.lit(event).alias("event"))}
    return TX.run(procedure, _BOOKS, _books(spark, d), triggers={"account": [trigger]})[0]["notes"]


@query("SELECT c_custkey AS id, c_custkey AS v FROM customer WHERE c_custkey <= 20")
def view_function(spark, d):
    return TX.view(lambda t, most: t.scan("account").where(F.col("id") <= most), _BOOKS, _books(spark, d), 20)


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN -1 WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey END AS v
       FROM customer WHERE c_custkey % 10 <> 9 OR c_custkey % 3 = 0"""
)
def optimistic_layers(spark, d):
    """Of three unanswered calls one is confirmed, one rolled back; the last, on top, stays as it was applied."""
    base = _books(spark, d)["account"]
    cache = CH.Optimistic(base, ["id"])
    even = base.where("id % 2 = 0").select("id", (F.col("v") + 1).alias("v"))
    cache.apply("a", upserts=even)
    cache.apply("b", upserts=base.select("id", F.lit(0).cast("long").alias("v")))
    cache.apply("c", upserts=base.where("id % 3 = 0").select("id", F.lit(-1).cast("long").alias("v")), deletes=base.where("id % 10 = 9 and id % 3 <> 0"))
    cache.confirm("a", CH.upsert(base, even, ["id"]))
    cache.rollback("b")
    return cache.rows()


@query(
    """WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT event_id, user_id, us, n, 1.0::DOUBLE AS left_, true AS admitted FROM c WHERE n = 1
              UNION ALL SELECT c.event_id, c.user_id, c.us, c.n, t - CAST(t >= 1 AS INT), t >= 1
              FROM (SELECT c.*, least(2.0::DOUBLE, r.left_ + (c.us - r.us) * 0.0001::DOUBLE / 1e6) AS t FROM c JOIN r ON c.user_id = r.user_id AND c.n = r.n + 1) c)
       SELECT event_id, admitted FROM r"""
)
def rate_limit_admissions(spark, d):
    calls = Tables(spark, d).events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return CH.token_bucket(calls, "user_id", "at_us", 2, 0.0001).select("event_id", "admitted")


@query("SELECT c_custkey AS id, 2 AS v FROM customer WHERE c_custkey % 4 <> 0")
def changes_in_one_transaction(spark, d):
    """Three changes of a key in one transaction, in the order of ``seq``: the last is what stands."""
    ids = Tables(spark, d).customer.select(F.col("c_custkey").alias("id"))
    row = lambda v: F.struct("id", F.lit(v).alias("v"))
    none = F.lit(None).cast("struct<id: bigint, v: int>")
    first = ids.select(F.lit(1).alias("tx_id"), F.lit(1).alias("seq"), F.lit("insert").alias("op"), "id", none.alias("before"), row(1).alias("after"))
    second = ids.select(F.lit(1).alias("tx_id"), F.lit(2).alias("seq"), F.lit("update").alias("op"), "id", row(1).alias("before"), row(2).alias("after"))
    third = ids.where("id % 4 = 0").select(F.lit(1).alias("tx_id"), F.lit(3).alias("seq"), F.lit("delete").alias("op"), "id", row(2).alias("before"), none.alias("after"))
    return CH.replay(second.unionByName(third).unionByName(first), ["id"])
