import hashlib
from collections import defaultdict

from quire.llm import linededup as L
from quire.llm.common import WHITE


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows, least=5):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(WHITE))
            if i is not None and len(k) >= 40:
                docs[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(docs[lower(x.strip(WHITE))]) < least or max(docs[lower(x.strip(WHITE))]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def got(df, **kw):
    return sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in L.digest(L.dedup_lines(df, **kw)).collect())


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_planted_lines(spark):
    line = "This line is found in many documents, é and all of it"
    rows = [(i, f"own {i}\n \t{line.upper() if i % 2 else line} \r\nmore\n{line}") for i in range(7)]
    rows += [(7, line), (7, line), (8, "short"), (9, "ÉÉ" * 25), (None, line), (10, "")]
    rows += [(20 + i, "another line that only four of the documents hold at all") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert got(df, batches=1) == got(df, batches=5, fanout=3) == got(df, broadcast=0)


def test_whole_table(documents):
    assert got(documents) == brute(rows_of(documents))


def test_edge_cases(sample, nothing):
    assert L.dedup_lines(nothing).count() == 0
    assert got(sample) == got(sample, broadcast=0, min_docs=5) == brute(rows_of(sample))


def test_later_batches_see_earlier_ones(spark):
    store = L.LineRuns(fanout=2)
    line = "a line of text that is long enough to be a key of its own {}"
    for n, fresh in ((0, 4), (2, 2), (4, 2), (1, 0)):
        batch = spark.createDataFrame([(100 * n + k, line.format(n + k)) for k in range(4)], "doc_id long, text string")
        assert L.new_lines(store, batch).select("key").distinct().count() == fresh
    assert len(store.runs()) <= 2
    assert {r.n_docs for r in store.common(1).collect()} == {1, 2, 3} and store.common(1).count() == 8
    assert {(r.n_docs, r.last_doc) for r in store.common(3).collect()} == {(3, 200), (3, 201), (3, 400)}


def test_batches_merge_with_the_runs_without_an_exchange(spark, documents):
    store = L.LineRuns(fanout=9)
    hashes = L.line_hashes(documents)
    for k in range(2):
        store.add(hashes.where(f"doc_id % 3 = {k}"))
    batch = store._write(hashes.where("doc_id % 3 = 2").distinct().groupBy("key").count())
    joined = batch
    for r in store.runs():
        joined = joined.join(r.select("key").hint("merge"), "key", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    merged = store._merged(store.runs())
    keys = {bytes(r.key) for r in hashes.where("doc_id % 3 < 2").collect()}
    assert {bytes(r.key) for r in merged.collect()} == keys and merged.count() == len(keys)
    want = {k: n for k, n in hashes.where("doc_id % 3 < 2").distinct().groupBy("key").count().rdd.map(lambda r: (bytes(r[0]), r[1])).collect() if n >= 3}
    assert {bytes(r.key): r.n_docs for r in store.common(3).collect()} == want
    assert spark.catalog.listTables() == []


def test_columns_stay(sample):
    out = L.without_lines(sample, *L.repeated_lines(sample))
    assert out.columns == [*sample.columns, "n_lines", "n_dropped"]


def test_columns_of_the_same_names_stay(sample):
    odd = sample.selectExpr("*", "'a' as n_lines", "'b' as n_dropped", "'c' as _keys", "'d' as _of")
    for broadcast in (0, 10):
        out = L.without_lines(odd, *L.repeated_lines(odd), broadcast=broadcast)
        assert out.columns == [*odd.columns, "n_lines_", "n_dropped_"]
        assert {(r.n_lines, r.n_dropped, r._keys, r._of) for r in out.collect()} == {("a", "b", "c", "d")}
