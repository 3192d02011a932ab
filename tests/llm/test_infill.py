import hashlib
import struct

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import infill


def by_contract(doc_id, text, seed=1):
    t = text or ""
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (doc_id, len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=300), st.integers(0, 3000))
def test_lists_give_back_their_numbers(values, more):
    own = np.array(sorted(values), np.int64)
    universe = int(own[-1]) + 1 + more if len(own) else more
    packed = infill.encode(own, universe)
    assert [infill.select(packed, k) for k in range(len(own) + 1)] == [*own.tolist(), universe] and infill.size(packed) == len(own)


def test_a_long_list_is_small_and_read_in_place():
    text = "aß日😀" * 50_000
    packed, offsets = infill.boundaries(text.encode()), np.cumsum([0] + [len(c.encode()) for c in text])
    assert all(infill.select(packed, k) == offsets[k] for k in range(0, len(text) + 1, 997))
    assert len(packed) < len(text) * 5 / 8


def test_cases_and_edges(spark, sample):
    more = spark.createDataFrame([(k, "a <P> b" if k % 3 else "<S ><M" * k, None, None, 0) for k in range(100, 160)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = sample.unionByName(more, allowMissingColumns=True)
    want = sorted(map(str, (by_contract(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())))
    for hot in (512, 1):
        out = infill.transform(docs, hot=hot)
        got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
        assert sorted(str(tuple(r)) for r in got) == want
        back = out.select(infill.restored(out["output"], out["form"]).alias("t")).collect()
        assert sorted(r.t for r in back) == sorted(r.text or "" for r in docs.select("text").collect())


def test_texts_with_one_hash_are_told_apart(spark):
    """Texts are compared whole: here every text has the same key."""
    rows = [(k, t) for k, t in enumerate(["ab", "b", "ab", "", "ñ", "ab", "b"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("text")
    got = docs.mapInArrow(lambda b: infill._indexed(b, 1), f"doc_id long, text string, {', '.join(f'{c} long' for c in infill.CUT)}").collect()
    assert all(r.n == len(r.text) and len(r.text[: r.a].encode()) == r.a_byte and len(r.text[: r.b].encode()) == r.b_byte for r in got) and len(got) == len(rows)


def test_a_list_is_made_once_for_equal_texts(monkeypatch):
    import pyarrow as pa

    made = []
    real = infill.boundaries
    monkeypatch.setattr(infill, "boundaries", lambda t: made.append(t) or real(t))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(["x"] * 700)], ["doc_id", "text"])] * 3
    assert sum(b.num_rows for b in infill._indexed(batches, 1)) == 2100 and made == [b"x"]


def test_texts_move_once(documents):
    plan = infill.transform(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_nothing(nothing):
    assert infill.digest(infill.transform(nothing)).collect() == []


def test_sql(documents):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(infill.SQL)
    names = [c[0] for c in want.description]
    got = infill.digest(infill.transform(documents)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
