"""Every registered query with SQL, against that SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from rivulet.plans import catalogue, serving  # noqa: F401 - registers its queries too

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(r[k]) for k in at] for r in want.fetchall())


def test_queries_without_sql(spark):
    a = catalogue.QUERIES["random_numbers"](spark, SF)
    assert sorted(a.collect()) == sorted(a.collect())
    assert all(0 <= r["die"] < 6 and 0 <= r["unit"] < 1 for r in a.collect())
    assert sum(r["n"] for r in catalogue.QUERIES["shard_hash_counts"](spark, SF).collect()) == 1500


def test_rate_limit_is_a_token_bucket(spark):
    from collections import defaultdict

    rows = catalogue.QUERIES["rate_limit"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["user_id"]].append((r["at_us"], r["event_id"], r["admitted"]))
    for calls in by.values():
        calls.sort()
        tokens, last = 2.0, calls[0][0]
        for at, _, admitted in calls:
            tokens, last = min(2, tokens + (at - last) * 0.0001 / 1e6), at
            assert admitted == (tokens >= 1)
            tokens -= admitted
    assert not all(r["admitted"] for r in rows)


def test_full_postings_hold_every_term(spark):
    import re

    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        at = {}
        for pos, word in enumerate(re.findall(r"[^\W_]+", r["text"] or "")):
            at.setdefault(word.lower(), []).append(pos)
        want |= {(r["doc_id"], term, len(p), p[0]) for term, p in at.items()}
    got = {tuple(r) for r in catalogue.QUERIES["fts_postings_full"](spark, SF).collect()}
    assert got == want
    assert {t[:1] for _, t, _, _ in got} > {"t"}
