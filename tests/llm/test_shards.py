import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from quire.llm import shards as S


def test_matrix_has_exact_sums_and_a_uniform_law():
    rows, sizes = np.array([5, 0, 40, 55]), S.capacities(100, 7)
    total = np.zeros((4, 7))
    for seed in range(400):
        m = S.communication_matrix(rows, sizes, seed)
        assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
        total += m
    want = np.outer(rows, sizes) / 100
    assert np.abs(total / 400 - want).max() < 0.6


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (1, 30, 1), (40, 3, 20), (200, 300, 90), (3, 500, 499)):
        draws = Counter(S._by_rejection(rng, good, bad, n) for _ in range(6000))
        total = math.comb(good + bad, n)
        law = {k: math.comb(good, k) * math.comb(bad, n - k) / total for k in range(max(0, n - bad), min(good, n) + 1)}
        chi = sum((draws[k] - 6000 * p) ** 2 / (6000 * p) for k, p in law.items() if 6000 * p > 5)
        assert set(draws) <= set(law) and chi < len(law) + 4 * (2 * len(law)) ** 0.5 + 6
    good, bad, n = 3 * 10**9, 10**9, 2 * 10**9
    draws = np.array([S._hypergeometric(rng, good, bad, n) for _ in range(600)], float)
    assert ((10**9 <= draws) & (draws <= n)).all()
    spread = math.sqrt(n * 0.75 * 0.25 * 0.5)
    assert abs(draws.mean() - 1.5e9) < 5 * spread / math.sqrt(600) and 0.85 < draws.std() / spread < 1.15


def test_keyed_permutation_is_one_to_one():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        out = S.keyed_permutation(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(out.tolist()) == list(range(n))


def check(df, n_shards=40):
    rows = S.shard_documents(df, n_shards).collect()
    source = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == source
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    counts = [len(slots.get(k, ())) for k in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_whole_table(documents):
    rows = check(documents.repartition(7))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in rows)


def test_edge_cases(sample, nothing):
    check(sample)
    check(sample, 3)
    assert S.shard_documents(nothing).count() == 0


def test_places_are_uniform(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'' as text").repartition(5, "doc_id")
    rows = S.shard_documents(df, 8).collect()
    table = Counter((r.doc_id // 1000, r.shard, r.slot // 250) for r in rows)
    chi = sum((table[a, b, c] - 62.5) ** 2 / 62.5 for a in range(4) for b in range(8) for c in range(2))
    assert chi < 63 + 4 * (2 * 63) ** 0.5


def test_written_shards(spark, documents, tmp_path):
    S.write_shards(documents, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 5


def test_the_query_moves_the_texts(documents, monkeypatch):
    moved, assign = [], S.assign
    monkeypatch.setattr(S, "assign", lambda rows, *a: moved.append(rows.columns) or assign(rows, *a))
    assert S.shard_documents(documents).count() == documents.count() and moved == [["doc_id", "text"]]


def test_columns_of_the_same_names_stay(sample):
    odd = sample.selectExpr("*", "'p' as _place", "'q' as slot")
    out = S.assign(odd, 4)
    assert out.columns == [*odd.columns, "shard_", "slot_"] and {(r.shard, r.slot, r._place) for r in out.collect()} == {(1, "q", "p")}
