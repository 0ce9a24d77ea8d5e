"""Rules that the tables of the driver do not show: nulls, NaN, errors, governance, writes, cascades."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rivulet import errors as E
from rivulet import types
from rivulet.functions import crdt, values
from rivulet.operators import changes, constraints, fulltext, governance, hybrid, views
from rivulet.operators.select import Between, Bounds, Cmp, Eq, In, Match, Order, Radius, Region, Select, compile_select, lookup
from rivulet.schema import Catalog, Column, ForeignKey, Index, SchemaError, TableSpec, Visibility, diff, migrate, with_columns

ITEM = TableSpec(
    "item",
    (Column("id", "id"), Column("category", "str"), Column("price", "f64"), Column("note", "str", nullable=True), Column("flag", "bool"), Column("owner", "identity")),
    ("id",),
    indexes=(Index("btree", ("category", "price")), Index("fulltext", ("note",), "english", True, True)),
).validate()


def items(spark):
    nan = float("nan")
    rows = [(1, "a", 1.0, "A rare sword of the ancient kings", True, "x"), (2, "a", nan, "running shoes", False, "y"), (3, "b", -0.0, None, True, "x"), (4, "b", 5.0, "kings ancient", True, "y")]
    return spark.createDataFrame(rows, ITEM.struct)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "where,want",
    [
        ((Cmp("price", ">", 0.0),), [1, 4]),
        ((Cmp("price", ">=", 0),), [1, 3, 4]),
        ((Eq("price", 0.0),), [3]),
        ((Between("price", -1, 10),), [1, 3, 4]),
        ((Eq("note", "running shoes"),), [2]),
        ((Eq("flag", True), In("category", ("a",))), [1]),
        ((Match("note", "kings"),), [1, 4]),
        ((Match("note", '"sword of the ancient"'),), [1]),
        ((Match("note", '"sword ancient"'),), []),
        ((Match("note", "running*"),), []),
        ((Match("note", "runn*"),), [2]),
    ],
)
def test_predicates(spark, where, want):
    assert ids(compile_select(Select("item", where), ITEM).apply(items(spark))) == want


@pytest.mark.parametrize(
    "select,error",
    [
        (Select("item", (Eq("nope", 1),)), E.UnknownColumn),
        (Select("item", (Eq("price", "1"),)), E.TypeMismatch),
        (Select("item", (Eq("id", -1),)), E.TypeMismatch),
        (Select("item", (Eq("id", 1.0),)), E.TypeMismatch),
        (Select("item", (Cmp("flag", "<", True),)), E.TypeMismatch),
        (Select("item", (Between("note", "a", "b"),)), E.TypeMismatch),
        (Select("item", (Cmp("price", "!=", 1),)), E.Unsupported),
        (Select("item", (In("id", ()),)), E.Unsupported),
        (Select("item", spatial=Region(0, 0, 1, 1)), E.NoSpatialIndex),
        (Select("item", (Match("note", "a"), Match("note", "b"))), E.Unsupported),
        (Select("item", (Match("category", "a"),)), E.Unsupported),
        (Select("item", (Match("note", "kings OR shoes"),)), E.Unsupported),
        (Select("item", (Match("note", "ki*gs"),)), E.Unsupported),
        (Select("item", (Match("note", ""),)), E.Unsupported),
        (Select("item", order=Order("SCORE", True)), E.Unsupported),
        (Select("item", after=(1.0, 1)), E.Unsupported),
        (Select("item", order=Order("owner"), after=("x", 1)), E.Unsupported),
    ],
)
def test_refusals(select, error, spark):
    with pytest.raises(error) as e:
        compile_select(select, ITEM)
    assert e.value.code == error.code


def test_spatial_refusals(spark):
    spec = with_columns(ITEM, columns=(*ITEM.columns, Column("x", "f64"), Column("y", "f64")), indexes=(Index("quadtree", ("x", "y")),))
    with pytest.raises(E.Malformed):
        compile_select(Select("item", spatial=Radius(-1, 0, 0)), spec)
    with pytest.raises(E.Malformed):
        compile_select(Select("item", spatial=Region(float("inf"), 0, 0, 0)), spec)


def test_radius_takes_its_rim(spark):
    spec = TableSpec("p", (Column("id", "id"), Column("x", "f64"), Column("y", "f64")), ("id",), indexes=(Index("quadtree", ("x", "y")),))
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 3.0, 4.1), (3, float("nan"), 0.0)], spec.struct)
    assert ids(compile_select(Select("p", spatial=Radius(5, 0, 0)), spec).apply(df)) == [1]


def test_bounds(spark):
    plan = compile_select(Select("item", limit=3), ITEM)
    assert plan.apply(items(spark), Bounds(max_limit=2)).count() == 2
    assert compile_select(Select("item"), ITEM).apply(items(spark), Bounds(default_limit=1)).count() == 1
    with pytest.raises(E.LimitRejected):
        plan.apply(items(spark), Bounds(max_limit=2, reject=True))
    with pytest.raises(E.ScanBudgetExceeded):
        plan.apply(items(spark), Bounds(scan_budget=3))


def test_score_column_and_order(spark):
    plan = compile_select(Select("item", (Match("note", "kings"),), order=Order("SCORE", True), score=True), ITEM)
    rows = plan.apply(items(spark)).collect()
    assert [r["id"] for r in rows] == [4, 1] and rows[0]["_score"] > rows[1]["_score"] > 0


def test_normalized_names_equal_requests():
    a = Select("item", (Eq("id", 1), Eq("category", "it's")), order=Order("price"), limit=5)
    assert a.normalized() == "SELECT * FROM item WHERE id = 1 AND category = 'it''s' ORDER BY price ASC LIMIT 5"
    assert a.query_hash() == Select("item", (Eq("id", 1), Eq("category", "it's")), order=Order("price"), limit=5).query_hash()
    assert a.query_hash() != a.query_hash("someone") and a.query_hash() != Select("item").query_hash()


def test_explain_is_the_plan(spark, tmp_path):
    items(spark).write.parquet(str(tmp_path / "i"))
    request = compile_select(Select("item", (Eq("category", "a"), Cmp("price", ">", 1)), order=Order("price", True), limit=5), ITEM)
    plan = request.explain(spark.read.parquet(str(tmp_path / "i")))
    assert "EqualTo(category,a)" in plan["access"][0] and "GreaterThan(price,1.0)" in plan["access"][0]
    assert "isnan" in plan["residual"][0] and "TakeOrderedAndProject" in plan["plan"]
    assert (plan["table"], plan["order"], plan["limit"], plan["cursor"]) == ("item", "price desc", 5, None)


def test_filters_reach_the_scan(spark, tmp_path):
    items(spark).write.parquet(str(tmp_path / "i"))
    plan = compile_select(Select("item", (Eq("category", "a"), Between("price", 0, 3))), ITEM).apply(spark.read.parquet(str(tmp_path / "i")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,a)" in text and "GreaterThanOrEqual(price,0.0)" in text


def test_lookup(spark):
    assert ids(lookup(items(spark), ITEM, (3,))) == [3] and ids(lookup(items(spark), ITEM, (9,))) == []


@pytest.mark.parametrize(
    "word, want",
    [
        ("parties", "party"), ("classes", "class"), ("running", "runn"), ("quickly", "quick"), ("blessedly", "bless"), ("walked", "walk"), ("boxes", "box"),
        ("cats", "cat"), ("class", "class"), ("string", "string"), ("ties", "tie"), ("is", "is"), ("sses", "sse"), ("ing", "ing"),
    ],
)
def test_stems_are_the_same_on_both_sides(spark, word, want):
    assert spark.range(1).select(fulltext.stem(F.lit(word))).first()[0] == want
    assert fulltext.Analyzer("english", True, True).terms_of(f"x {word.upper()}")[1:] == ([(1, want)] if word != "is" else [])


def test_null_documents_count(spark):
    df = items(spark)
    analyzer = fulltext.Analyzer()
    stats = fulltext.corpus_stats(fulltext.document_lengths(df, "id", "note", analyzer)).first()
    assert stats["n_docs"] == 4 and stats["avg_len"] == (7 + 2 + 0 + 2) / 4


def test_duplicate_items_count_twice(spark):
    analyzer = fulltext.Analyzer()
    once = fulltext.bm25(items(spark), "id", "note", "kings", analyzer).collect()
    twice = {r["id"]: r["_score"] for r in fulltext.bm25(items(spark), "id", "note", "kings kings", analyzer).collect()}
    assert {r["id"]: pytest.approx(2 * r["_score"]) for r in once} == twice


def test_stored_postings_score_alike(spark):
    analyzer = fulltext.Analyzer("english", True, True)
    post, lengths = fulltext.postings(items(spark), "id", "note", analyzer), fulltext.document_lengths(items(spark), "id", "note", analyzer)
    for query in ("kings", 'ki* "sword of the ancient"', '"ancient kings" sword'):
        stored = {r["id"]: r["_score"] for r in fulltext.bm25_from_postings(post, lengths, "id", query, analyzer).collect()}
        direct = {r["id"]: pytest.approx(r["_score"]) for r in fulltext.bm25(items(spark), "id", "note", query, analyzer).collect()}
        assert stored == direct and stored


def test_repeated_word_in_a_phrase(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a a b"), (3, "b a")], "id long, note string")
    assert ids(fulltext.bm25(df, "id", "note", '"a a"', fulltext.Analyzer())) == [2]
    assert ids(df.where(fulltext.matches(F.col("note"), '"a a"', fulltext.Analyzer()))) == [2]


def test_rerank_survives_its_hook(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(6)], "id long, score double")
    order = lambda hook: [r["id"] for r in hybrid.rerank(df, "id", "score", hook, 3).orderBy("position").collect()]
    assert order(lambda head: 1 / 0) == [5, 4, 3, 2, 1, 0]
    assert order(lambda head: spark.createDataFrame([(3, 1), (99, 2)], "id long, rank int")) == [3, 5, 4, 2, 1, 0]


def test_search_survives_its_hooks(spark):
    from rivulet.operators import hybrid

    lexical = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, s double")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    dense = lambda k: spark.createDataFrame([(3, 0.9), (2, 0.8), (9, 0.7), (4, None)], "id long, score double").limit(k)
    order = lambda df: [r["id"] for r in df.orderBy(*hybrid.fused_order()).collect()]
    got = hybrid.search(lexical, rows, "id", "s", dense)
    assert order(got) == [2, 1, 3]  # 9 is no row that may be seen
    assert {r["id"]: r["lexical_rank"] for r in got.collect()} == {1: 1, 2: 2, 3: None}

    def broken(*_):
        raise ValueError("down")

    lazy = lambda k: dense(k).withColumn("score", F.raise_error(F.lit("down")).cast("double"))
    for hook in (broken, lazy):
        with pytest.warns(UserWarning, match="retriever failed"):
            assert order(hybrid.search(lexical, rows, "id", "s", hook)) == [1, 2]
    with pytest.warns(UserWarning, match="fusion failed"):
        assert order(hybrid.search(lexical, rows, "id", "s", dense, broken)) == [2, 1, 3]
    assert order(hybrid.search(lexical.limit(0), rows.limit(0), "id", "s", dense)) == []


def test_zero_vectors_have_no_cosine(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<float>")
    assert ids(hybrid.vector_topk(df, "id", "v", [1.0, 0.0])) == [2]


# Views


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from("ab"), st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=25), st.randoms())
def test_incremental_views_agree(spark, writes, rng):
    schema = "id long, g string, v long"
    live, batches = {}, []
    for k in range(0, len(writes), 8):
        before = dict(live)
        for i, g, v in writes[k : k + 8]:
            if i in live and rng.random() < 0.4:
                del live[i]
            else:
                live[i] = (i, g, v)
        gone = [before[i] for i in before if live.get(i) != before[i]]
        come = [live[i] for i in live if before.get(i) != live[i]]
        batches.append((come, gone))
    table = spark.createDataFrame(list(live.values()), schema)
    for view in (views.MatView("v", "t", "sum", "v", "g"), views.MatView("v", "t", "min", "v", "g"), views.MatView("v", "t", order_by="v", limit=3, key="id")):
        state = None
        for come, gone in batches:
            state = views.merge_state(view, state, views.signed(spark.createDataFrame(come, schema), spark.createDataFrame(gone, schema)))
        if view.aggregate == "sum":
            mine = {r["group"]: int(r["value"]) for r in views.read_state(view, state).collect()}
            assert mine == {r["group"]: int(r["value"] or 0) for r in views.compute(view, table).collect()}
        else:
            assert views.agrees(view, state, table)


def test_view_declarations():
    for bad in ({}, {"aggregate": "median", "column": "v"}, {"aggregate": "sum"}, {"order_by": "v"}, {"aggregate": "count", "order_by": "v"}):
        with pytest.raises(E.Unsupported):
            views.MatView("v", "t", **bad)


def test_delta_of_equal_states_is_empty(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "group string, value long")
    view = views.MatView("v", "t", "count", group_by="g")
    assert views.view_delta(view, df, df).count() == 0


# Governance and values


def test_masks(spark):
    spec = with_columns(
        ITEM,
        columns=(Column("id", "id"), Column("category", "str", mask="redact", grant="owner"), Column("price", "f64", mask="null", grant="role:bank"), Column("note", "str", nullable=True, mask="null", grant="role:bank"), Column("flag", "bool"), Column("owner", "identity")),
        owner="owner",
    )
    rows = {r["id"]: r for r in governance.project(items(spark), spec, governance.Viewer("x")).collect()}
    assert rows[1]["category"] == "a" and rows[2]["category"] == "" and rows[1]["price"] == 0.0 and rows[1]["note"] is None
    peer = {r["id"]: r for r in governance.project(items(spark), spec, governance.Viewer("", is_peer=True)).collect()}
    assert peer[1]["price"] == 1.0 and peer[1]["note"]
    assert governance.Viewer("x", frozenset({"bank"})).scope(spec) != governance.Viewer("x").scope(spec)
    assert governance.Viewer("x").scope(TableSpec("t", (Column("id", "id"),), ("id",))) == ""


def test_seals_are_bound(spark):
    key = "00112233445566778899aabbccddeeff"
    one = spark.range(1).select(governance.seal(F.lit("secret"), key, "t").alias("c"), governance.sign(F.lit("secret"), key).alias("s"))
    row = one.select(
        governance.open_sealed(F.col("c"), key, "t"), governance.open_sealed(F.col("c"), key, "other"), governance.verify(F.lit("secret"), F.col("s"), key), governance.verify(F.lit("forged"), F.col("s"), key), "s"
    ).first()
    import hashlib
    import hmac

    assert tuple(row)[:4] == ("secret", None, True, False)
    assert row["s"] == hmac.new(bytes.fromhex(key), b"secret", hashlib.sha256).hexdigest()


@pytest.mark.parametrize("text,want", [("1.50", "1.50"), (" -3 ", "-3.00"), (".5", "0.50"), ("+2.1000", "2.10"), ("1.234", None), ("", None), ("1e3", None)])
def test_money(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(values.money(F.col("t"), 2).alias("m"))
    if want is None:
        with pytest.raises(PySparkException):
            df.collect()
    else:
        assert df.first()["m"] == Decimal(want)


def test_buckets_before_the_epoch(spark):
    row = spark.createDataFrame([(-1,)], "us long").select(values.time_bucket(F.col("us"), 10), values.bucket_index(F.col("us"), 10)).first()
    assert tuple(row) == (-10, -1)


@pytest.mark.parametrize("value,kind,ok", [(255, "u8", True), (256, "u8", False), (-1, "u64", False), (2**64 - 1, "u64", True), (True, "i32", False), (1, "f64", True), ("x", "bytes", False), (1.0, "timestamp", False)])
def test_literals(spark, value, kind, ok):
    if ok:
        types.literal(value, types.TYPES[kind])
    else:
        with pytest.raises(E.TypeMismatch):
            types.literal(value, types.TYPES[kind])


# Schema


@pytest.mark.parametrize(
    "bad",
    [
        {"columns": ()},
        {"primary_key": ()},
        {"primary_key": ("id", "id")},
        {"auto_inc": True, "primary_key": ("category",)},
        {"access": "global", "partition_by": "category"},
        {"unique": ((),)},
        {"indexes": (Index("quadtree", ("price",)),)},
        {"indexes": (Index("fulltext", ("price",)),)},
        {"visibility": Visibility("shard_local")},
        {"columns": (*ITEM.columns[:2], Column("price", "f64", mask="hash"), *ITEM.columns[3:])},
    ],
)
def test_schema_refusals(bad):
    with pytest.raises(SchemaError):
        with_columns(ITEM, **bad).validate()


def test_schema_diff(spark):
    old = TableSpec("t", (Column("id", "id"), Column("a", "str")), ("id",))
    kinds = lambda *columns, key=("id",): {(c.kind, c.allowed) for c in diff(old, TableSpec("t", columns, key))}
    assert kinds(*old.columns) == set()
    assert kinds(*old.columns, Column("b", "i32", default=1)) == {("add_column", True)}
    assert kinds(*old.columns, Column("b", "i32")) == {("add_column_without_default", False)}
    assert kinds(Column("b", "i32", default=1), *old.columns) == {("add_column", False)}
    assert kinds(old.columns[0]) == {("remove_column", False)}
    assert kinds(old.columns[0], Column("a", "i32")) == {("change_type", False)}
    assert kinds(*reversed(old.columns)) == {("reorder_columns", False)}
    assert kinds(old.columns[0], Column("z", "str", renamed_from="a")) == {("rename_column", True)}
    with pytest.raises(SchemaError):
        migrate(spark.createDataFrame([], old.struct), old, TableSpec("t", (old.columns[0],), ("id",)))


# Writes and logs


def test_conflicting_insert(spark):
    with pytest.raises(E.UniqueViolation):
        changes.insert(items(spark), items(spark).limit(1), ["id"])


@pytest.mark.parametrize("change,error", [({"category": None}, E.NotNullViolation), ({"price": -5.0}, E.CheckViolation), ({"id": 1}, E.UniqueViolation)])
def test_validate(spark, change, error):
    spec = with_columns(ITEM, columns=tuple(Column(c.name, c.type, c.nullable, check="price >= 0 or isnan(price)" if c.name == "price" else None) for c in ITEM.columns))
    good = [r.asDict() for r in items(spark).collect()]
    schema = ", ".join(f"{c.name} {c.kind.spark}" for c in spec.columns)
    frame = lambda rows: spark.createDataFrame([tuple(r[c.name] for c in spec.columns) for r in rows], schema)
    constraints.validate(frame(good), spec)
    with pytest.raises(error):
        constraints.validate(frame([*good[:3], good[3] | change]), spec)


def test_foreign_keys(spark):
    node = TableSpec("node", (Column("id", "id"), Column("parent", "id", nullable=True)), ("id",), foreign_keys=(ForeignKey("parent", "node", "id", "cascade"),))
    leaf = TableSpec("leaf", (Column("id", "id"), Column("node", "id")), ("id",), foreign_keys=(ForeignKey("node", "node", "id"),))
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4)], "id long, parent long")  # 1, 3, 2 form a cycle
    leaves = spark.createDataFrame([(1, 5)], "id long, node long")
    catalog = Catalog(node, leaf)
    after = constraints.delete_with_actions({"node": nodes, "leaf": leaves}, catalog, "node", nodes.where("id = 1"))
    assert ids(after["node"]) == [4, 5]
    with pytest.raises(E.ForeignKeyViolation):
        constraints.delete_with_actions({"node": nodes, "leaf": leaves}, catalog, "node", nodes.where("id = 4"))
    with pytest.raises(E.ForeignKeyViolation):
        constraints.validate(spark.createDataFrame([(1, 77)], "id long, node long"), leaf, {"node": nodes})


def test_triggers_cascade_and_stop(spark):
    row = spark.createDataFrame([(1,)], "id long")
    out = constraints.run_triggers({"a": row}, {"a": [lambda event, rows: {"b": rows.selectExpr("id + 1 as id")}]})
    assert ids(out["a"]) == [1] and ids(out["b"]) == [2]
    with pytest.raises(E.EngineError):
        constraints.run_triggers({"a": row}, {"a": [lambda event, rows: {"a": row}]})


LOG = "tx_id long, ts timestamp, op string, id long, before struct<id:long,v:long>, after struct<id:long,v:long>"


def log(spark):
    rows = [
        (1, None, "insert", 1, None, (1, 5)),
        (2, None, "insert", 2, None, (2, 50)),
        (3, None, "update", 1, (1, 5), (1, 60)),
        (4, None, "update", 2, (2, 50), (2, 6)),
        (5, None, "update", 1, (1, 60), (1, 70)),
        (6, None, "delete", 1, (1, 70), None),
        (7, None, "update", 2, (2, 6), (2, 7)),
    ]
    return spark.createDataFrame(rows, LOG)


def test_deltas_follow_the_predicate(spark):
    got = changes.deltas(log(spark), lambda row: row["v"] >= 50, ["id"]).collect()
    assert sorted((r["tx_id"], r["op"], r["id"]) for r in got) == [(2, "insert", 2), (3, "insert", 1), (4, "delete", 2), (5, "insert", 1), (6, "delete", 1)]
    assert all((r["row"] is None) == (r["op"] == "delete") for r in got)


def test_folded_deltas_are_the_table(spark):
    held = {}
    for r in changes.deltas(log(spark), lambda row: row["v"] < 50, ["id"]).orderBy("tx_id").collect():
        held.pop(r["id"], None)
        if r["op"] == "insert":
            held[r["id"]] = r["row"]["v"]
    assert held == {r["id"]: r["v"] for r in changes.replay(log(spark), ["id"]).where("v < 50").collect()} == {2: 7}


def test_points_in_time(spark):
    assert ids(changes.as_of(log(spark), ["id"], tx=5)) == [1, 2] and ids(changes.as_of(log(spark), ["id"], tx=99)) == [2]
    with pytest.raises(E.OutOfWindow):
        changes.as_of(log(spark), ["id"], tx=1, oldest_tx=2)
    assert changes.retained(log(spark), 2).count() == 2


def test_resume_or_reset(spark):
    deltas = changes.deltas(log(spark), lambda row: row["v"] >= 0, ["id"])
    rows, reset = changes.resume(deltas, 5, window=3)
    assert not reset and sorted(r["tx_id"] for r in rows.collect()) == [6, 7]
    assert changes.resume(deltas, 2, window=3)[1]


def test_auto_increment_over_partitions(spark):
    rows = spark.range(100).select(F.when(F.col("id") == 50, 500).otherwise(0).cast("long").alias("n"), F.col("id").alias("at")).repartition(7)
    got = sorted((r["at"], r["n"]) for r in changes.auto_increment(rows, "n", 10, ["at"]).collect())
    assert got == [(k, 500 if k == 50 else 501 + k - (k > 50)) for k in range(100)]


def test_documents_converge(spark):
    ops = crdt.typed(1, "abc") + [(1, "insert", 4, 2, 2, 1, "X"), (1, "insert", 4, 3, 2, 1, "Y"), (1, "delete", 5, 2, 1, 1, None)] + crdt.typed(2, "")
    want = "bYXc"
    for rows in (ops, ops[::-1], ops + ops):
        got = {r["doc_id"]: r["text"] for r in crdt.texts(spark.createDataFrame(rows, crdt.OPS)).collect()}
        assert got == {1: want}
    old, new = spark.createDataFrame(ops[:3], crdt.OPS), spark.createDataFrame(ops, crdt.OPS)
    assert crdt.patch(old, new).count() == 3 and crdt.next_seq(new).first()["next_seq"] == 6


# Transactions

PARENT = TableSpec("parent", (Column("id", "id"), Column("v", "i64")), ("id",))
CHILD = TableSpec("child", (Column("id", "id"), Column("parent", "id"), Column("twice", "i64", computed="parent * 2")), ("id",), foreign_keys=(ForeignKey("parent", "parent", "id", "cascade"),))
TABLES = Catalog(PARENT, CHILD)


def state(spark):
    return {"parent": spark.createDataFrame([(1, 10), (2, 20)], "id long, v long"), "child": spark.createDataFrame([(1, 1, 2), (2, 2, 4)], "id long, parent long, twice long")}


def test_transaction_sees_its_writes_and_commits_them(spark):
    from rivulet.operators import txn

    seen = {}

    def procedure(t):
        t.insert("parent", spark.createDataFrame([(3, 30)], "id long, v long"))
        t.insert("child", spark.createDataFrame([(7, 3, 0)], "id long, parent long, twice long"))
        t.upsert("parent", spark.createDataFrame([(2, 20), (1, 11)], "id long, v long"))
        t.delete_where("parent", F.col("v") == 20)
        seen.update(scan=ids(t.scan("parent")), pending=ids(t.scan_pending("parent")), old=ids(t.snapshot("parent")), one=t.get("parent", 1).first()["v"])

    tables, log = txn.run(procedure, TABLES, state(spark))
    assert seen == {"scan": [1, 3], "pending": [1, 3], "old": [1, 2], "one": 11}
    assert ids(tables["parent"]) == [1, 3] and sorted(map(tuple, tables["child"].select("id", "parent", "twice").collect())) == [(1, 1, 2), (7, 3, 6)]
    assert sorted((r["op"], r["id"]) for r in log["parent"].collect()) == [("delete", 2), ("insert", 3), ("update", 1)]
    assert sorted((r["op"], r["id"]) for r in log["child"].collect()) == [("delete", 2), ("insert", 7)]


def test_transaction_refuses_as_a_whole(spark):
    from rivulet.operators import txn

    before = state(spark)
    with pytest.raises(E.UniqueViolation):
        txn.run(lambda t: t.insert("parent", spark.createDataFrame([(1, 0)], "id long, v long")), TABLES, before)
    with pytest.raises(E.ForeignKeyViolation):
        txn.run(lambda t: t.insert("child", spark.createDataFrame([(9, 9, 0)], "id long, parent long, twice long")), TABLES, before)
    with pytest.raises(E.EngineError):
        endless = lambda t: t.call(endless)
        txn.run(endless, TABLES, before)
    tables, log = txn.run(lambda t: (t.insert("parent", spark.createDataFrame([(5, 0)], "id long, v long")), t.delete("parent", spark.createDataFrame([(5,)], "id long"))), TABLES, before)
    assert ids(tables["parent"]) == [1, 2] and log["parent"].count() == 0


def test_triggers_of_a_transaction(spark):
    from rivulet.operators import txn

    trigger = lambda event, rows: {"child": rows.selectExpr("id + 100 as id", "id as parent", "cast(id * 2 as long) as twice")}
    tables, _ = txn.run(lambda t: t.insert("parent", spark.createDataFrame([(3, 30)], "id long, v long")), TABLES, state(spark), triggers={"parent": [trigger]})
    assert ids(tables["child"]) == [1, 2, 103]


def test_deadline(spark):
    from rivulet.operators.limits import within

    assert within(spark, 60, lambda: spark.range(3).count()) == 3
    slow = spark.range(0, 1 << 36, 1, 64).select(F.sum(F.sqrt("id")))
    with pytest.raises(E.DeadlineExceeded):
        within(spark, 1, slow.collect)


def test_triggers_are_told_of_updates_and_deletions(spark):
    from rivulet.operators import txn

    heard = []

    def trigger(event, rows):
        heard.append((event, ids(rows)))
        return {}

    def procedure(t):
        t.upsert("parent", spark.createDataFrame([(1, 11), (3, 30)], "id long, v long"))
        t.delete("parent", spark.createDataFrame([(2,)], "id long"))

    txn.run(procedure, TABLES, state(spark), triggers={"parent": [trigger]})
    assert sorted(heard) == [("delete", [2]), ("insert", [3]), ("update", [1])]
    with pytest.raises(E.EngineError):
        txn.view(lambda t: (t.insert("parent", spark.createDataFrame([(9, 0)], "id long, v long")), t.scan("parent"))[1], TABLES, state(spark))


def test_auto_increment_numbers_null_ids(spark):
    rows = spark.createDataFrame([(0, 1), (5, 2), (None, 3)], "id long, at long")
    assert sorted((r["at"], r["id"]) for r in changes.auto_increment(rows, "id", 0, ["at"]).collect()) == [(1, 6), (2, 5), (3, 7)]


def test_net_change_of_one_transaction(spark):
    rows = [(1, 2, "update", 1, (1, 5), (1, 6)), (1, 1, "insert", 1, None, (1, 5)), (1, 3, "delete", 2, (2, 8), None), (1, 2, "update", 2, (2, 7), (2, 8))]
    df = spark.createDataFrame(rows, "tx_id long, seq long, op string, id long, before struct<id:long,v:long>, after struct<id:long,v:long>")
    got = {r["id"]: (r["op"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in changes.net_changes(df, ["id"]).collect()}
    assert got == {1: ("insert", None, 6), 2: ("delete", 7, None)}


def test_rerank_survives_a_hook_that_fails_when_it_runs(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(6)], "id long, score double")
    broken = lambda head: head.select("id", F.raise_error(F.lit("no")).cast("int").alias("rank"))
    with pytest.warns(UserWarning):
        assert [r["id"] for r in hybrid.rerank(df, "id", "score", broken, 3).orderBy("position").collect()] == [5, 4, 3, 2, 1, 0]


@pytest.mark.parametrize("text", ["हिन्दी भाषा में", "ภาษาไทย ง่าย", "العربيّة لغة", "Ünïcödé ΟΔΟΣ ǅ x²y", "don't 3.5 a_b"])
def test_queries_are_cut_like_documents(spark, text):
    analyzer = fulltext.Analyzer()
    df = spark.createDataFrame([(1, text), (2, "other")], "id long, note string")
    for word in text.split():
        assert ids(df.where(fulltext.matches(F.col("note"), word, analyzer))) == [1], word
    assert ids(df.where(fulltext.matches(F.col("note"), f'"{text}"', analyzer))) == [1]


def test_a_match_is_answered_from_stored_postings(spark, tmp_path):
    plan = compile_select(Select("item", (Match("note", "kings"),), order=Order("SCORE", True), score=True), ITEM)
    index = fulltext.StoredIndex.write(items(spark), "id", "note", plan.match[2], str(tmp_path))
    direct = [(r["id"], pytest.approx(r["_score"])) for r in plan.apply(items(spark)).collect()]
    stored = plan.apply(items(spark), index=index)
    assert [(r["id"], r["_score"]) for r in stored.collect()] == direct and direct
    assert "EqualTo(term,king" in stored._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_to_tasks_by_their_operations(spark, monkeypatch):
    monkeypatch.setattr(crdt, "TASK_OPS", 50)
    ops = [o for k in range(40) for o in crdt.typed(k, f"text {k}")]
    found = crdt.texts(spark.createDataFrame(ops + ops, crdt.OPS))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {k: f"text {k}" for k in range(40)}
    assert found.rdd.getNumPartitions() == -(-2 * len(ops) // 50)


def test_a_stored_index_analyses_each_text_once(spark, tmp_path):
    judged = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            judged.add(batch.num_rows)
            yield batch

    rows = [(1, "b a B c"), (2, None), (3, "a b a b")]
    df = spark.createDataFrame(rows, "id long, note string").mapInArrow(seen, "id long, note string")
    index = fulltext.StoredIndex.write(df, "id", "note", fulltext.Analyzer(), str(tmp_path))
    assert judged.value == len(rows)
    assert sorted(map(tuple, index.lengths.collect())) == [(1, 4), (2, 0), (3, 4)]
    assert sorted(map(tuple, index.post.where("id = 1").collect())) == [(1, "a", 1), (1, "b", 0), (1, "b", 2), (1, "c", 3)]


def test_unicode_forms_in_batches_of_bounded_bytes(spark, monkeypatch):
    import unicodedata

    told = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")
    texts = [None, "", "plain\nlines", "café ˿\u0000", "café", "가 ﬁ ½", "Å\n̈́", "\U0001d15e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for form in ("nfc", "nfd", "nfkc", "nfkd"):
        got = {r["id"]: r["t"] for r in df.select("id", values.normalize_string(F.col("t"), form).alias("t")).collect()}
        assert got == {k: t if t is None else unicodedata.normalize(form.upper(), t) for k, t in enumerate(texts)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304b"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", told)


def test_term_counts_shuffle_no_words_and_add_up_shared_keys(spark):
    rows = [(1, "b a B"), (2, "a"), (2, "c a"), (None, "a"), (None, "a b"), (3, None), (4, ""), (5, "A" * 3)]
    df = spark.createDataFrame(rows, "id long, note string")
    found = fulltext.term_counts(df, "id", "note", fulltext.Analyzer())
    want = [(1, "a", 1, 1), (1, "b", 2, 0), (2, "a", 2, 0), (2, "c", 1, 0), (5, "aaa", 1, 0), (None, "a", 2, 0), (None, "b", 1, 1)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    stages = found._jdf.queryExecution().sparkPlan().toString()
    assert stages.count("HashAggregate") == 2  # partial and final, of the rows that share their key
