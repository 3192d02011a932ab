import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(D):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "page", "text"] and df.count() > 0


def plain(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES and not re.match(r"op\d|pipeline", n)))
def test_query_matches_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, D), db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, got.collect()) == plain(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not re.match(r"op\d|pipeline", n)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_exact_extraction_scores_one(spark):
    r = QUERIES["accuracy_metric"](spark, D).selectExpr("avg(char_accuracy) a", "avg(word_error_rate) e").first()
    assert r.a == 1 and r.e == 0
