import random
import re

import numpy as np
import pytest

from quire.llm import minhash as M
from quire.llm import nearcopies as N
from quire.llm import resemblance as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, words=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else [])


def groups(sets, similarity=0.8):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x == y or similarity * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) / len(x | y) >= similarity:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(sets))]


def survivors(rows, similarity=0.8):
    """Rows (doc_id, text) that stay, by all pairs: of each group the smallest doc_id."""
    group, best = groups([shingle_set(t) for _, t in rows], similarity), {}
    for (i, t), g in zip(rows, group):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return [(i, t) for (i, t), g in zip(rows, group) if (i is None, i or 0) == best[g]]


def kept(df):
    return sorted(str((r.doc_id, r.text)) for r in N.keep_one(df).collect())


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert kept(documents) == sorted(str(x) for x in survivors(rows)) and len(kept(documents)) < len(rows)


def edited(rng, words, n):
    w = list(words)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_edited_copies(spark):
    """Copies with so many words replaced that the similarity is around 0.8."""
    rng = random.Random(4)
    docs = []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 90, 300]))]
        docs += [edited(rng, words, rng.randrange(len(words) // 30 + 1)) for _ in range(4)]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = {i for i, _ in survivors(rows)}, {r.doc_id for r in N.keep_one(df).collect()}
    assert want <= got and len(got) <= len(want) + 0.03 * (len(rows) - len(want))


def test_a_crowd_of_different_copies_is_one_group(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, edited(rng, words, 2)) for k in range(700)] + [(5000 + k, f"other text number {k} with words of its own {k * 7} {k * 11}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in N.keep_one(df).collect()} == {0} | {5000 + k for k in range(20)}
    assert {r.doc_id for r in N.keep_one(df, cell=64).collect()} == {0} | {5000 + k for k in range(20)}


def test_spanning_tree_takes_the_nearest():
    fp = np.array([0, 0b1, 0b11, 0b111, (1 << 40) - 1], np.int64)
    name = np.arange(10, 15)
    u, v = R.forest(np.zeros(5, np.int64), name, fp, np.zeros(5, np.int64), 28, trees=1)
    assert {frozenset(x) for x in zip(u.tolist(), v.tolist())} == {frozenset(x) for x in ((10, 11), (11, 12), (12, 13))}
    u, v = R.forest(np.zeros(5, np.int64), name, fp, np.zeros(5, np.int64), 28)
    assert {frozenset(x) for x in zip(u.tolist(), v.tolist())} == {frozenset((a, b)) for a in range(10, 14) for b in range(a + 1, 14)} and len(u) == 6
    u, v = R.forest(np.zeros(3, np.int64), name[:3], fp[:3], fp[:3], 28)
    assert {frozenset(x) for x in zip(u.tolist(), v.tolist())} == {frozenset((a, b)) for a in range(10, 13) for b in range(a + 1, 13)}
    u, v = R.forest(np.array([1, 2, 2, 3, 3]), name, fp, fp, 28)
    assert list(zip(u.tolist(), v.tolist())) == [(11, 12)]


def test_edge_cases(spark, sample, nothing):
    assert N.keep_one(nothing).count() == 0
    out = N.keep_one(sample)
    assert out.columns == sample.columns
    assert kept(sample) == sorted(str(x) for x in survivors([(r.doc_id, r.text) for r in sample.collect()]))
    rows = [(1, "a b c d e f g"), (1, "other words that are not like these at all"), (None, "A B C D E F G"), (None, "only here and nowhere else, twice"), (None, "only here and nowhere else, twice"), (0, "a b")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as set", "2 as h", "3 as fp", "4 as best", "5 as _h")
    assert sorted(str((r.doc_id, r.text)) for r in N.keep_one(df).collect()) == sorted(str(x) for x in (rows[0], rows[1], rows[3], rows[4], rows[5]))
    assert N.keep_one(df).columns == df.columns


def test_no_link_is_left_to_chance(spark):
    """Pairs of similarity 0.8 exactly: of so many, bands miss some."""
    docs = []
    for g in range(3000):
        words = [f"g{g}w{k}" for k in range(9)]
        docs += [" ".join(words), " ".join(words[g % 2 : g % 2 + 8])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id for r in N.keep_one(df).collect()} == set(range(0, 6000, 2))


def test_a_family_below_the_threshold_stays(spark):
    """Copies at about 0.75 of one another, in crowded cells, and a few that link some."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, edited(rng, words, 6)) for k in range(300)]
    rows += [(1000 + k, edited(rng, rows[k][1].split(" "), 2)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(i for i, _ in survivors(rows))
    assert sorted(r.doc_id for r in N.keep_one(df, cell=32).collect()) == want and 150 < len(want) < len(rows)


def test_pairs_that_cannot_reach_cost_no_row(spark):
    """Of all pairs of a family at about 0.7 of one another, parities let few through."""
    rng = random.Random(10)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, edited(rng, words, 9)) for k in range(200)]
    own = M.sketches(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("set").toPandas()
    column = lambda c: own[c].to_numpy()
    u, _ = M.across(np.zeros(200, np.int64), column("set"), column("set"), column("fp"), column("low"), column("n"), column("parity"), 0.8)
    assert len(u) < 200


def test_parities_rule_out_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(rng.integers(0.75 * n, n + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if shared / (len(x) + len(y) - shared) >= 0.8:
            assert R.can_reach(len(x), R.parity(x), len(y), R.parity(y), 0.8)
            for wide in (2, 4):
                px, py = np.array([R.parity(x, wide), R.parity(y, wide)], object), (0.2 / 1.8) * (len(x) + len(y)) + 1e-6
                assert M._close(px, np.array([0]), np.array([1]), np.array([py]))[0]
    x, y = (rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(2))
    assert not R.can_reach(300, R.parity(x), 300, R.parity(y), 0.8)
