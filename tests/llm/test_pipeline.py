"""The pipeline's stages, each held against brute force on its own input."""

import hashlib

import corpus_pipeline
import pytest

from .test_operators import SF, brute_classes, brute_contamination


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in out]


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_keep_the_columns(stages):
    for rows in stages[:-1]:
        assert set(rows[0]) == set(corpus_pipeline.COLUMNS)


def test_language_keeps_prose(stages):
    assert set(ids(stages[0])) - set(ids(stages[1])) == {r["doc_id"] for r in stages[0] if not any(c.isalpha() for c in r["text"] or "")}


def test_exact(stages):
    best = {}
    for r in stages[1]:
        best[r["text"] or ""] = min(best.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    assert ids(stages[2]) == sorted(best.values())


def test_near(stages):
    want = {c[1] for c in brute_classes([(r["doc_id"], r["text"]) for r in stages[2]])}
    assert ids(stages[3]) == sorted(want)


def test_contaminated(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute_contamination([(r["doc_id"], r["text"]) for r in stages[3]], items)
    assert ids(stages[4]) == sorted(r[0] for r in judged if not r[5])


def test_encoded(stages):
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert {r["doc_id"]: r["decoded_sha256"] for r in stages[5]} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in text.items()}


def test_run_is_the_stages_in_a_row(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, (r.asDict() for r in got.collect()))) == sorted(map(repr, stages[-1]))


@pytest.mark.parametrize("letters", [200, 2000, 20000])
def test_language_rejects_noise_and_keeps_short_texts(spark, letters):
    import base64
    import random

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    draw = random.Random(letters)
    noise = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=letters)), "".join(draw.choices("abcdefghijklmnopqrstuvwxyz     ", k=letters)), base64.b64encode(draw.randbytes(letters)).decode()]
    words = next(r["text"] for r in docs.where("lang = 'en' and n_chars > 400").orderBy("doc_id").collect()).split()
    clean = [" ".join(words[:n]) for n in (1, 2, 5, 10, 20, 40)]
    clean += ["Xylyl qwz", "Zyzzyva"]  # too short to judge
    rows = [(-1 - k, t) for k, t in enumerate(noise + clean)]
    more = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    assert {i for i, _ in rows} & got == {i for i, _ in rows[len(noise) :]}


def test_near_keeps_one_of_each_class_whatever_the_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).schema
    groups = {g: [" ".join(f"{g}{n}" for n in range(100)) + f" {g}-{k}" for k in range(3)] for g in "abcde"}
    ids_of = {"a": [None, None, None], "b": [None, 5, 9], "c": [1, 1, 2], "d": [1, 7, 8], "e": [6, None, 1]}  # a: null ids alone; c and d: ids repeated within and over classes
    rows = [(i, t, None, None, len(t)) for g in groups for i, t in zip(ids_of[g], groups[g])]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r["text"][0], repr(r["doc_id"])) for r in kept) == [("a", "None"), ("b", "5"), ("c", "1"), ("d", "1"), ("e", "1")]
