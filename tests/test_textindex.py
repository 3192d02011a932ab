import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.textindex import RUNS, TextIndex, packed, postings, unpacked

SCHEMA = "doc_id string, page int, text string"


def rows(df):
    return sorted(map(str, map(tuple, df.select("doc_id", "page", "offset", "context").collect())))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    made = [(str(k), p, "".join(rng.choices(["a", "A", "b", "é", " ", "the ", "日", "\n", "aba"], k=rng.randrange(0, 200)))) for k in range(120) for p in range(2)]
    return made + [("n", 0, None), ("e", 0, ""), ("s", 0, "a"), ("s", 1, "ab"), ("z", 0, "x\0\0"), ("t", 0, "end the")]


def test_hits_equal_a_scan(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    index = TextIndex(spark, f"file://{tmp_path}/i")
    assert index.search("the").collect() == []
    for k in range(3):
        assert index.add(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k), f"b{k}")
    assert not index.add(df, "b1")
    queries = ["The ", "aba", "abaaba", "é", "日a", "a", "ab", "the the", "nothing at all", "\0", "x\0", "d the", "", "AAAA", "\n"]
    want = {q: rows(search.search(df, q)) for q in queries}
    for _ in range(2):
        assert {q: rows(index.search(q)) for q in queries} == want and len(want["aba"]) > 100
        index.compact()
        index.vacuum()
    assert len(index.state()["runs"]) == 1 and len(index.state()["batches"]) == 3


def test_many_batches_are_merged(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    for k in range(RUNS + 2):
        index.add(spark.createDataFrame([(str(k), 0, f"page number {k}")], SCHEMA), str(k))
    assert len(index.state()["runs"]) == 2 and index.search("number").count() == RUNS + 2


def test_a_run_that_was_not_committed_counts_nothing(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame([("a", 0, "one word")], SCHEMA), "0")
    monkeypatch.setattr(TextIndex, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.add(spark.createDataFrame([("b", 0, "two words")], SCHEMA), "1")
    monkeypatch.undo()
    assert [r.doc_id for r in index.search("word").collect()] == ["a"]
    index.add(spark.createDataFrame([("c", 0, "three words")], SCHEMA), "1")
    assert sorted(r.doc_id for r in index.search("word").collect()) == ["a", "c"]


def test_a_search_opens_the_buckets_of_its_trigrams(spark, pages, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(pages, SCHEMA), "0")
    plan = index.candidates("aba")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan
    assert "dynamicpruning" in index.search("aba")._jdf.queryExecution().executedPlan().toString().lower()


def test_postings_are_written_once_and_small(spark, tmp_path):
    """No exchange, and a few bytes of postings for a byte of text."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(500)]
    made = [(str(k), 0, " ".join(rng.choices(words, k=400))) for k in range(300)]
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(made, SCHEMA).coalesce(2), "0")
    found = postings(index._pages(index.state()["runs"]))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    size = sum(f.stat().st_size for f in (tmp_path / "i" / "postings").rglob("*.parquet"))
    assert size < 4 * sum(len(t) for *_, t in made)
    assert rows(index.search(words[0])) == rows(search.search(spark.createDataFrame(made, SCHEMA), words[0]))


def test_numbers_are_packed():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 33, (1 << 62) + 5, 3])
    data, ends = packed(values)
    assert unpacked(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data) and ends[3] == 5
    assert len(packed(values[:0])[0]) == 0 == len(unpacked(b""))
