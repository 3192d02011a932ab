import random
import time

from pyspark.sql import functions as F

from quire.operators import likeness as L


def by_table(x, y):
    """The usual table of lengths."""
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for k, d in enumerate(y):
            row[k + 1], last = (last + 1 if c == d else max(row[k], row[k + 1])), row[k + 1]
    return row[-1]


def frame(spark, rows):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(rows)], "id long, x string, y string").repartition(3)


def test_short_texts_are_exact(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcé日😀 ", k=rng.randrange(0, 40)))
    rows = [(word(), word()) for _ in range(300)] + [(None, "a"), (None, None), ("", ""), ("same", "same"), ("a", None)]
    got = {r.id: (r.n, r.m, r.common) for r in L.common(frame(spark, rows)).collect()}
    assert got == {k: (len(x or ""), len(y or ""), by_table(x or "", y or "")) for k, (x, y) in enumerate(rows)}
    alike = {r.id: r.likeness for r in L.likeness(frame(spark, rows)).collect()}
    assert alike[301] == alike[302] == alike[303] == 1 and alike[300] == 0


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + rng.randrange(0, 9)] = rng.choices("xyz", k=rng.randrange(0, 9))
    return "".join(t)


def test_anchors_lose_nothing_where_texts_differ_in_places(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = []
    for _ in range(12):
        x = text(3000)
        y = edited(rng, x, rng.choice([1, 5, 15]))
        rows.append((x, y))
    rows += [(text(2000), text(2000)), ("ab" * 1500, "ba" * 1500), (text(900) + rows[0][0], rows[0][0] + text(900))]
    exact = {k: by_table(x, y) for k, (x, y) in enumerate(rows)}
    cut = {r.id: r.common for r in L.common(frame(spark, rows), whole=1000).collect()}
    assert all(cut[k] <= exact[k] for k in exact) and all(cut[k] >= exact[k] - 2 for k in range(12))
    assert cut[12] == exact[12] and cut[13] == exact[13] and cut[14] == exact[14]


def test_long_texts_are_linear(spark):
    rng, took = random.Random(3), []
    for n in (100_000, 400_000):
        x = "".join(rng.choices("abcdefghijklmnop ", k=n))
        rows = [(x, edited(rng, x, n // 400)) for _ in range(2)]
        began = time.perf_counter()
        got = L.likeness(frame(spark, rows)).agg(F.min("likeness")).first()[0]
        took.append(time.perf_counter() - began)
        assert 0.97 < got < 1
    assert took[1] < 6 * took[0] + 2


def test_words(spark):
    rows = [("a  b\nc d", "a b x d"), ("one", "one"), ("", "")]
    got = {r.id: (r.char_accuracy, r.word_error_rate) for r in L.accuracy(frame(spark, rows)).collect()}
    assert got == {0: (6 / 7, 0.25), 1: (1.0, 0.0), 2: (1.0, 0.0)}


def test_equal_texts_are_neither_written_nor_compared(spark):
    from quire.operators import likeness as L

    rows = [(1, "a  b ", "a b"), (2, None, ""), (3, "", None)]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    got = L.accuracy(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, got.collect())) == [(k, 1.0, 0.0) for k in (1, 2, 3)]
    more = L.accuracy(df.unionAll(spark.createDataFrame([(4, "a b", "a c"), (5, "x", "")], df.schema))).orderBy("id").collect()
    assert [tuple(r) for r in more[:3]] == [(k, 1.0, 0.0) for k in (1, 2, 3)]
    assert (round(more[3].char_accuracy, 9), more[3].word_error_rate, more[4].char_accuracy, more[4].word_error_rate) == (round(4 / 6, 9), 0.5, 0.0, 1.0)
