import random

import numpy as np

from quire.llm import decontam as D

BENCH = "item_id long, text string"


def sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max() / (D.MATCH * len(a))


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 6, rng.integers(1, 15)) for _ in range(80)]
    b = [rng.integers(0, 6, rng.integers(1, 30)) for _ in range(80)]
    scores, _ = D.align(a, b)
    assert np.allclose(scores, [sw(x, y) for x, y in zip(a, b)])


def passage(rng, n=30):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def edited(rng, text, every):
    w = text.split()
    for k in range(2, len(w), every):
        w[k] = "changed" if k % 3 else ""
    return " ".join(filter(None, w))


def test_whole_edited_and_clean(spark):
    rng = random.Random(7)
    items = [passage(rng) for _ in range(20)]
    docs, want = [], set()
    for i in range(200):
        t = passage(rng, 120)
        if i % 5 == 0:
            k = i % len(items)
            t = f"{t} {(items[k].title() if i % 2 else edited(rng, items[k], 6))}. {passage(rng, 50)}"
            want.add((i, k))
        docs.append((i, t))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), BENCH)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench, block=1200).collect()} == want
    assert {r.doc_id for r in D.keep_clean(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_copies_do_not_make_an_item_common(spark):
    rng = random.Random(8)
    item = passage(rng)
    docs = [(i, passage(rng, 20) + " " + item) for i in range(400)] + [(1000 + i, passage(rng, 60)) for i in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], BENCH)
    assert {r.doc_id for r in D.contaminated(df, bench).collect()} == set(range(400))


def test_a_crowd_of_equal_edited_copies_is_found(spark):
    rng = random.Random(9)
    item = passage(rng, 15)
    w = item.split()
    for k in (3, 7, 11):
        w[k] = "changed"
    docs = [(0, passage(rng, 20) + " " + item)] + [(1 + i, f"{passage(rng, 20)} {' '.join(w)} {passage(rng, 20)}") for i in range(1000)]
    docs += [(2000 + i, f"{passage(rng, 20)} {' '.join(w[4:7])} {passage(rng, 20)}") for i in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], BENCH)
    assert {r.doc_id for r in D.contaminated(df, bench).collect()} == set(range(1001))


def whole(items, text, batch=4000):
    """Scores of all items against a whole text, without seeds or passages."""
    ids = {}
    own = [np.array([ids.setdefault(w, len(ids)) for w in x], np.int64) for x in items]
    t = np.array([ids.get(w, -1) for w in D.words(text)], np.int64)
    return np.concatenate([D.align(own[k : k + 40], [t] * len(own[k : k + 40]))[0] for k in range(0, len(own), 40)]) if len(t) else np.zeros(len(own))


def test_against_whole_alignments(documents, spark):
    bench = [(r.item_id, D.words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(documents, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    want = {}
    for r in documents.collect():
        if len(r.text or "") < 20_000:
            for (k, _), s in zip(bench, whole([w for _, w in bench], r.text or "").tolist()):
                if s >= D.MIN_SCORE:
                    want[r.doc_id, k] = s
    long = {r.doc_id for r in documents.collect() if len(r.text or "") >= 20_000}
    got = {x: s for x, s in got.items() if x[0] not in long}
    assert set(got) <= set(want), "a pair that whole alignment does not confirm"
    assert want and len(got) >= 0.95 * len(want)
    assert all(abs(got[x] - want[x]) < 1e-9 or got[x] < want[x] for x in got)


def test_edited_copies_are_found(spark):
    """Every third to eighth word replaced, dropped or doubled: what scores 0.5 or
    more under whole alignment is found, and nothing else; of items under 15 words
    some copies keep no three words in a row, and have no seed."""
    rng = random.Random(12)
    items = [passage(rng, n) for n in (4, 8, 15, 30, 60, 150) for _ in range(4)]
    docs = []
    for i in range(240):
        w = items[i % len(items)].split()
        for k in range(rng.randrange(3), len(w), rng.randrange(3, 9)):
            w[k] = rng.choice(["changed", "", w[k] + " " + w[k]])
        docs.append((i, f"{passage(rng, 40)} {' '.join(w)} {passage(rng, 40)}"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), BENCH)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    want = {(i, k) for i, t in docs for k, s in enumerate(whole([D.words(x) for x in items], t)) if s >= D.MIN_SCORE}
    assert got <= want
    for least, share in ((15, 1.0), (8, 0.97), (4, 0.9)):
        own = {x for x in want if len(items[x[1]].split()) >= least}
        assert len(own & got) >= share * len(own) and len(own) > 100


def test_items_of_one_or_two_words_and_long_ones(spark):
    rng = random.Random(13)
    long = passage(rng, 3000)
    docs = [(0, "alpha beta gamma"), (1, "beta alpha"), (2, "x alphabeta"), (3, passage(rng, 500) + " " + long + " " + passage(rng, 500)), (4, " ".join(long.split()[1000:])), (5, " ".join(long.split()[2000:]))]
    bench = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, long), (4, "?!")], BENCH)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1), (0, 2), (3, 3), (4, 3)}


def test_rows_are_judged_by_their_text(spark):
    rng = random.Random(14)
    item = passage(rng, 20)
    rows = [(1, item), (1, "clean text of the same document"), (None, "x " + item), (None, "clean too"), (2, None), (3, "")]
    kept = D.keep_clean(spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'k' as _id", "'h' as _h"), spark.createDataFrame([(7, item)], BENCH))
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [(1, "clean text of the same document"), (None, "clean too"), (2, None), (3, "")]))
    assert kept.columns == ["doc_id", "text", "_id", "_h"]


def test_edge_cases(spark, sample, nothing):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, None), (3, ""), (4, "the of"), (None, "x y z a b"), (5, "word word word word"), (6, "The quick brown fox jumps over the lazy dog again")], BENCH)
    got = sorted(str((r.doc_id, r.item_id)) for r in D.contaminated(sample, bench).collect())
    assert got == sorted(str(x) for x in [(i, k) for i in (0, 0, 1, None) for k in (1, 6)] + [(8, 5), (10, 4)])
    assert D.contaminated(nothing, bench).count() == 0
    none = spark.createDataFrame([], BENCH)
    assert D.contaminated(sample, none).count() == 0 and D.keep_clean(sample, none).count() == sample.count()
    assert D.keep_clean(sample, bench).columns == sample.columns
