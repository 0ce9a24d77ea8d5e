"""Registered queries of what serves readers and writers: live plans, transactions, versions, formats, hybrid search."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions import crdt
from rivulet.operators import changes as CH
from rivulet.operators import constraints as CO
from rivulet.operators import fulltext as FT
from rivulet.operators import governance as GO
from rivulet.operators import hybrid as HY
from rivulet.operators import spatial as SP
from rivulet.operators import txn as TX
from rivulet.operators import views as VI
from rivulet.operators.select import Cmp, Eq, Order, Select, compile_select, index_layout
from rivulet.plans import catalogue as C
from rivulet.plans import specs as S
from rivulet.plans.catalogue import Tables, query
from rivulet.schema import Catalog, TableSpec, with_columns
from rivulet.schema import Column as ColumnSpec
from rivulet.sources.shared import shared_dir
from rivulet.sources.tables import VersionedTable, get_blobs, put_blobs, read
from rivulet.streaming.live import Subscriptions


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rivulet/{label}-{uuid.uuid4().hex}"


# Sources and versions


@query("SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) k(kind)")
def file_formats(spark, d):
    nation = Tables(spark, d).nation.select("n_nationkey", "n_name", "n_regionkey")
    parts = []
    for kind in ("csv", "json", "orc", "parquet"):
        path = _folder(spark, kind)
        nation.write.format(kind).save(path)
        parts.append(read(spark, path, kind, nation.schema).select(F.lit(kind).alias("kind"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """SELECT 'first' AS what, c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'live', c_custkey FROM customer
       UNION ALL SELECT 'copy', c_custkey FROM customer UNION ALL SELECT 'change', c_custkey FROM customer WHERE c_custkey % 2 <> 0"""
)
def versions_and_backup(spark, d):
    keys = Tables(spark, d).customer.select("c_custkey")
    table, copy = VersionedTable(spark, _folder(spark, "versions")), _folder(spark, "backup")
    table.commit(keys.where("c_custkey % 2 = 0"), keys.limit(0))
    table.commit(keys, keys.where("c_custkey % 2 != 0"))
    table.copy_to(copy)
    parts = {"first": table.snapshot(1), "live": table.snapshot(), "copy": VersionedTable(spark, copy).snapshot(), "change": table.changes(1)}
    out = [rows.select(F.lit(what).alias("what"), "c_custkey") for what, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT doc_id, sha256(text) AS text_hash, text FROM documents")
def blobs_by_content(spark, d):
    path = _folder(spark, "blobs")
    slim = put_blobs(Tables(spark, d).documents.select("doc_id", F.encode("text", "UTF-8").alias("text")), "text", path)
    return get_blobs(slim, "text", path).select("doc_id", F.col("text").alias("text_hash"), F.decode("payload", "UTF-8").alias("text"))


@query("SELECT * FROM part WHERE p_brand = 'Brand#11' AND p_size BETWEEN 5 AND 30 ORDER BY p_size DESC, p_partkey DESC LIMIT 15")
def index_ordered_scan(spark, d):
    """A request on a table that is laid out by its index."""
    path = _folder(spark, "layout")
    index_layout(Tables(spark, d).part, S.PART.indexes[0]).write.parquet(path)
    request = Select("part", (Eq("p_brand", "Brand#11"), Cmp("p_size", ">=", 5), Cmp("p_size", "<=", 30)), order=Order("p_size", True), limit=15)
    return compile_select(request, S.PART).apply(read(spark, path))


@query("SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 100 AS DOUBLE) AS y FROM customer WHERE c_nationkey = 3 AND c_custkey % 100 BETWEEN 7 AND 7")
def spatial_point_stored(spark, d):
    rows = C.points(Tables(spark, d)).join(Tables(spark, d).customer.select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    grid = rows.select("id", F.col("c_nationkey").cast("double").alias("x"), (F.col("id") % 100).cast("double").alias("y"))
    return grid.where(SP.point_at(F.col("x"), F.col("y"), 3.0, 7.0))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18, 2)) > CAST(1234.5 AS DECIMAL(20, 4)) AND CAST(o_totalprice AS DECIMAL(18, 2)) <= CAST(50000 AS DECIMAL(12, 0))")
def decimal_compare(spark, d):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return Tables(spark, d).orders.where((price > F.lit("1234.5").cast("decimal(20,4)")) & (price <= F.lit(50000).cast("decimal(12,0)"))).select("o_orderkey")


# Logs and live plans


@query(f"WITH {C._LOG} SELECT tx_id, user_id FROM log WHERE tx_id >= (SELECT min(tx_id) FROM (SELECT DISTINCT tx_id FROM log ORDER BY tx_id DESC LIMIT 64))")
def retained_window(spark, d):
    return CH.retained(C.event_log(Tables(spark, d))).select("tx_id", "user_id")


_USER = TableSpec("user_state", (ColumnSpec("user_id", "id"), ColumnSpec("value", "f64"), ColumnSpec("event_type", "str")), ("user_id",))


@query(
    f"""WITH {C._LOG}, q AS (SELECT *, event_type AS new_type FROM log), now AS (SELECT * FROM q WHERE live), was AS (SELECT * FROM q WHERE had)
        SELECT 'click' AS plan, tx_id, 'insert' AS op, user_id FROM now WHERE new_type = 'click'
        UNION ALL SELECT 'click', tx_id, 'delete', user_id FROM was WHERE old_type = 'click' AND NOT (live AND new_type = old_type)
        UNION ALL SELECT 'view', tx_id, 'insert', user_id FROM now WHERE new_type = 'view'
        UNION ALL SELECT 'view', tx_id, 'delete', user_id FROM was WHERE old_type = 'view' AND NOT (live AND new_type = old_type)
        UNION ALL SELECT 'dear', tx_id, 'insert', user_id FROM now WHERE value > 50
        UNION ALL SELECT 'dear', tx_id, 'delete', user_id FROM was WHERE old_value > 50 AND NOT (live AND value > 50)"""
)
def live_plan_deltas(spark, d):
    """Two plans that meet the batch in one join, and one by its own predicate."""
    subs = Subscriptions(Catalog(_USER))
    asked = {"click": Eq("event_type", "click"), "view": Eq("event_type", "view"), "dear": Cmp("value", ">", 50.0)}
    names = {subs.add("c", Select("user_state", (c,)), GO.Viewer("x")): name for name, c in asked.items()}
    out = subs.deltas(C.event_log(Tables(spark, d)), "user_state")
    name = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("query_id")]
    return out.select(name.alias("plan"), "tx_id", "op", "user_id")


@query("SELECT * FROM orders WHERE o_custkey = 37 AND o_totalprice > 1000 ORDER BY o_totalprice, o_orderkey LIMIT 7")
def sub_initial_snapshot(spark, d):
    subs = Subscriptions(S.CATALOG)
    request = Select("orders", (Cmp("o_totalprice", ">", 1000.0),), order=Order("o_totalprice"), limit=7)
    return subs.initial(subs.add("c", request, GO.Viewer("37")), Tables(spark, d).orders)


@query('SELECT event_type AS "group", max(value) AS value FROM events GROUP BY 1')
def view_by_name(spark, d):
    subs = Subscriptions(S.CATALOG, (replace(C.V_MAX, name="peak"), replace(C.V_SUM, name="total")))
    return VI.compute(subs.add_view("c", "peak"), Tables(spark, d).events)


@query("SELECT * FROM (VALUES ('avg', true), ('count', true), ('max', true), ('min', true), ('sum', true)) v(aggregate, agrees)")
def view_rebuild_agrees(spark, d):
    """What batches made of a view's state against the whole table computed anew."""
    base, come, gone = C._event_batches(Tables(spark, d))
    after = base.join(gone.select("event_id"), "event_id", "left_anti").unionByName(come)
    found = [(v.aggregate, VI.agrees(v, VI.merge_state(v, VI.state_of(v, base), VI.signed(come, gone)), after)) for v in (C.V_AVG, C.V_COUNT, C.V_MAX, C.V_MIN, C.V_SUM)]
    return spark.createDataFrame(found, "aggregate string, agrees boolean")


_SOME = "(SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN value END AS value FROM events)"


@query(
    f"""SELECT 'asc' AS way, row_number() OVER (ORDER BY value NULLS FIRST, event_id) AS rank, value, event_id AS key FROM {_SOME} QUALIFY rank <= 30
        UNION ALL SELECT 'desc', row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS rank, value, event_id FROM {_SOME} QUALIFY rank <= 30"""
)
def view_topn_nulls(spark, d):
    some = Tables(spark, d).events.select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value"))
    top = lambda desc: VI.compute(VI.MatView("v", "events", order_by="value", desc=desc, limit=30, key="event_id"), some)
    return top(False).select(F.lit("asc").alias("way"), "*").unionByName(top(True).select(F.lit("desc").alias("way"), "*"))


@query("SELECT c_custkey AS doc_id, left(c_name, 2) || substring(c_name, 4) || '!' AS text FROM customer")
def crdt_text(spark, d):
    """Names typed a character at a time, their third character deleted and a mark put at the end by another writer; operations come twice and in no order."""
    typed = Tables(spark, d).customer.select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.split("c_name", "")).alias("k", "ch")).where("ch != ''")
    none, k = F.lit(None).cast("long"), F.col("k").cast("long")
    one = F.lit(1).cast("long")
    ops = typed.select("doc_id", F.lit("insert").alias("kind"), (k + 1).alias("seq"), one.alias("actor"), F.when(k > 0, k).alias("parent_seq"), F.when(k > 0, one).alias("parent_actor"), "ch")
    last = typed.groupBy("doc_id").agg((F.max("k") + 1).cast("long").alias("n"))
    two = F.lit(2).cast("long")
    mark = last.select("doc_id", F.lit("insert").alias("kind"), (F.col("n") + 1).alias("seq"), two.alias("actor"), F.col("n").alias("parent_seq"), one.alias("parent_actor"), F.lit("!").alias("ch"))
    gone = last.select("doc_id", F.lit("delete").alias("kind"), (F.col("n") + 2).alias("seq"), two.alias("actor"), F.lit(3).cast("long").alias("parent_seq"), one.alias("parent_actor"), F.lit(None).cast("string").alias("ch"))
    return crdt.texts(gone.unionByName(mark).unionByName(ops).unionByName(mark))


# Transactions and constraints


def _pending(t) -> None:
    old = t.snapshot("account")
    t.upsert("account", old.where("id % 5 = 0").select("id", (F.col("v") + 1).alias("v")))
    t.insert("account", old.where("id % 11 = 0").select((F.col("id") + 1000000).alias("id"), "v"))


@query("SELECT c_custkey AS id, c_custkey + 1 AS v FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, c_custkey FROM customer WHERE c_custkey % 11 = 0")
def txn_scan_pending(spark, d):
    """What a transaction wrote so far, and nothing else."""
    t = TX.Transaction(C._BOOKS, C._books(spark, d))
    _pending(t)
    return t.scan_pending("account")


@query(
    """SELECT 'own' AS seen, c_custkey AS id, c_custkey + CAST(c_custkey % 5 = 0 AS INT) AS v FROM customer UNION ALL SELECT 'own', c_custkey + 1000000, c_custkey FROM customer WHERE c_custkey % 11 = 0
       UNION ALL SELECT 'committed', c_custkey, c_custkey FROM customer"""
)
def txn_own_writes(spark, d):
    """A transaction reads its own writes over what was committed before it; others read the latter."""
    t = TX.Transaction(C._BOOKS, C._books(spark, d))
    _pending(t)
    own, committed = t.scan("account"), t.snapshot("account")
    return own.select(F.lit("own").alias("seen"), "id", "v").unionByName(committed.select(F.lit("committed").alias("seen"), "id", "v"))


@query(f"SELECT id, 'rtree' AS failed FROM {C._BOXES} WHERE min_x > max_x - 3 OR min_y > max_y - 5")
def rtree_check(spark, d):
    smaller = C.boxes(Tables(spark, d)).withColumns({"max_x": F.col("max_x") - 3, "max_y": F.col("max_y") - 5})
    return CO.check_violations(smaller, C.BOXES).select("id", F.array_join("failed", ",").alias("failed"))


# Governance and search


@query("SELECT c_custkey, c_name, c_nationkey, CAST(0 AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0")
def filter_before_mask(spark, d):
    """Conditions see what is stored; readers see what they are granted."""
    spec = C._masking(c_acctbal={"mask": "redact", "grant": "role:bank"})
    return GO.project(compile_select(Select("customer", (Cmp("c_acctbal", "<", 0.0),)), spec).apply(Tables(spark, d).customer), spec, GO.Viewer("1"))


@query("SELECT c_custkey, c_name, c_mktsegment, c_custkey % 5 <> 0 AS c_name_verified FROM customer")
def verified_columns(spark, d):
    """A sealed column is opened, a signed one gets its verdict beside it; a fifth of the rows have another's signature."""
    key = "00112233445566778899aabbccddeeff"
    columns = [replace(c, signed=c.name == "c_name", encrypted=c.name == "c_mktsegment") for c in S.CUSTOMER.columns if c.name in ("c_custkey", "c_name", "c_mktsegment")]
    spec = with_columns(S.CUSTOMER, columns=tuple(columns), foreign_keys=())
    signature = GO.sign(F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")), key)
    stored = Tables(spark, d).customer.select("c_custkey", "c_name", signature.alias("c_name_signature"), GO.seal(F.col("c_mktsegment"), key, "customer").alias("c_mktsegment"))
    return GO.project(stored, spec, GO.Viewer("1"), key)


@query(
    f"""WITH {C._BM25}, ok AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500),
        lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE doc_id IN (SELECT doc_id FROM ok)),
        den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM ({C._COS}) QUALIFY r <= 100)
        SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score, min(lr) AS lexical_rank FROM
        (SELECT doc_id, r, r AS lr FROM lex UNION ALL SELECT doc_id, r, NULL FROM den) WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY 1"""
)
def hybrid_filtered(spark, d):
    """What the retriever alone found passes the request's conditions too."""
    t = Tables(spark, d)
    allowed = lambda df: df.where("lang = 'en' and n_chars > 500")
    lexical = allowed(FT.with_score(t.documents, "text", 'the er* "of the"', C.SIMPLE).where(FT.matches(F.col("text"), 'the er* "of the"', C.SIMPLE)))
    retriever = lambda top: HY.vector_topk(t.embeddings, "vec_id", "embedding", C.VECTOR, top).withColumnRenamed("vec_id", "doc_id")
    out: DataFrame = HY.search(lexical, allowed(t.documents), "doc_id", "_score", retriever)
    return out.select("doc_id", F.round("score", 9).alias("score"), "lexical_rank")
