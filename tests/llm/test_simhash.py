import random

import numpy as np
import xxhash

from quire.llm import simhash as S


def fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """The group of each place in a list of fingerprints, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(fps):
        for b in range(a):
            if (x ^ fps[b]).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(fps))]


def named(rows):
    """(doc_id, fingerprint) of rows to the smallest doc_id of each row's group."""
    group, least = groups([f for _, f in rows]), {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]


def test_fingerprints(documents):
    for r in documents.limit(60).collect():
        assert S.fingerprint(r.text) == fp(r.text)
    assert S.fingerprint("One two") == fp("one TWO") != 0 and S.fingerprint(" \n") == 0
    long = " ".join(random.Random(1).choice("abcdef") * 3 for _ in range(70_000))
    assert S.fingerprint(long) == fp(long)


def test_every_close_pair_meets_at_an_anchor():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), d)) for x in base for d in (1, 2, 3)]
    fps = np.unique(np.array(base + near, np.uint64))
    row, anchor, home = S.anchors(fps)
    order = np.argsort(anchor, kind="stable")
    a, b = S._compare(anchor[order], fps[row][order].view(np.int64), home[order], 2)
    place = {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
    got = {tuple(sorted((place[x], place[y]))) for x, y in zip(a.tolist(), b.tolist())}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert got == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(close))) if i < j}
    assert home.sum() == 2 * len(fps)


def test_stars_keep_components():
    a, b = np.array([5, 6, 9, 20]), np.array([6, 7, 10, 20])
    u, v = S._stars(a, b)
    assert dict(zip(u.tolist(), v.tolist())) == {6: 5, 7: 5, 10: 9}


def linked(df, hot):
    from quire.plans.components import connected_components

    return {r.node: r.root for r in connected_components(S.links(df, hot)).collect()}


def test_crowded_anchors_lose_no_link(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 4, 6]))) for _ in range(400)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    group = groups(fps)
    least = {g: min(x for x, h in zip(signed, group) if h == g) for g in group}
    want = {x: least[g] for x, g in zip(signed, group) if group.count(g) > 1}
    assert linked(df, 512) == linked(df, 4) == want


def check(df):
    rows = [(r.doc_id, fp(r.text)) for r in df.select("doc_id", "text").collect()]
    want = sorted(str((i, format(f, "016x"), c)) for (i, f), c in zip(rows, named(rows)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in S.near_duplicates(df).collect()) == want


def test_links_go_through_rows_without_an_id_and_not_through_repeated_ids(spark, monkeypatch):
    """The fingerprint stands in the text: 1 - null - 2 are a chain, 3 has two rows."""
    monkeypatch.setattr(S, "fingerprints", lambda docs: docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as long) fp"))
    rows = [(1, "0"), (None, "1"), (2, "7"), (3, "1099511627776000"), (3, "70368744177664000"), (None, "-1"), (9, "-4")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(str((r.doc_id, r.component_id)) for r in S.near_duplicates(df).collect())
    want = named([(i, int(t) & (1 << 64) - 1) for i, t in rows])
    assert want == [1, 1, 1, 3, 3, 9, 9]
    assert got == sorted(str((i, c)) for (i, _), c in zip(rows, want))


def test_whole_table(documents):
    check(documents)


def test_edge_cases(sample, nothing):
    check(sample)
    assert S.near_duplicates(nothing).count() == 0
