import random

import numpy as np
import pytest

from quire.llm import minhash as M

from test_resemblance import edited, groups, shingle_set


def by_contract(rows, similarity=0.85):
    """All pairs of exact sets: (doc_id, n_shingles, component_id, kept)."""
    sets = [shingle_set(t) for _, t in rows]
    full = [k for k, s in enumerate(sets) if s]
    group, least = dict(zip(full, groups([sets[k] for k in full], similarity))), {}
    for k, g in group.items():
        i = rows[k][0]
        if i is not None:
            least[g] = min(least.get(g, i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(group[k]) if k in group else i
        out.append((i, len(sets[k]), c, None if i is None or c is None else i == c))
    return sorted(map(str, out))


def found(docs, **how):
    return sorted(str(tuple(r)) for r in M.near_duplicates(docs, **how).collect())


def test_signatures_estimate_the_similarity_with_less_variance():
    rng = np.random.default_rng(3)
    got = []
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 130).astype(np.uint64)
        y = np.concatenate([x[:110], rng.integers(0, 1 << 63, 20).astype(np.uint64)])
        s = M.signatures(np.concatenate([x, y]), np.repeat([0, 1], 130), 2)
        got.append((s[0] == s[1]).mean())
    j = 110 / 150
    assert abs(np.mean(got) - j) < 0.01 and np.std(got) < (j * (1 - j) / M.LANES) ** 0.5


def ranks(item, lanes=M.LANES):
    """An item's rank in each lane, by the definition."""
    lane, out = list(range(lanes)), [0] * lanes
    for j in range(lanes):
        z = int(M._mix(np.array([(item + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
        k = j + ((z & 0xFFFFFFFF) * (lanes - j) >> 32)
        lane[j], lane[k] = lane[k], lane[j]
        out[lane[j]] = j << 32 | z >> 32
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 9, 200, 3000])
def test_stopping_early_changes_nothing(size, monkeypatch):
    items = np.random.default_rng(size).integers(0, 1 << 63, size).astype(np.uint64)
    want = np.array([ranks(int(x)) for x in items], np.uint64).min(axis=0) if size else np.full(M.LANES, np.iinfo(np.uint64).max, np.uint64)
    for chunk in (M.CHUNK, 70):
        monkeypatch.setattr(M, "CHUNK", chunk)
        got = M.signatures(np.concatenate([items, items]), np.repeat([0, 2], size), 3)
        assert (got[0] == want).all() and (got[2] == want).all()


def test_steps_follow_the_size(monkeypatch):
    seen, real = [], M._mix
    monkeypatch.setattr(M, "_mix", lambda x: seen.append(len(x)) or real(x))
    M.signatures(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64), np.zeros(5000, np.int64), 1)
    assert len(seen) <= 3  # of 128


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents) == by_contract(rows)


def test_edited_copies(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        own = [f"w{rng.randrange(500)}x{k}" for _ in range(rng.choice([12, 40, 150, 400]))]
        rows.append((10 * k, " ".join(own)))
        rows += [(10 * k + n, edited(rng, own, max(1, round(len(own) * 0.008 * n)))) for n in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = by_contract(rows)
    assert found(docs) == want and len({x.split(", ")[2] for x in want}) < len(rows)


@pytest.mark.parametrize("cell", [4, 512])
def test_families_whose_cells_are_crowded(spark, cell):
    """A text with many copies that differ more from one another than from it, a chain, and
    copies that are all too far apart."""
    rng = random.Random(8)
    own, far = [f"a{k}" for k in range(300)], [f"b{k}" for k in range(300)]
    rows = [(0, " ".join(own))] + [(k, edited(rng, own, 4)) for k in range(1, 60)]
    rows += [(1000 + k, edited(rng, far, 9)) for k in range(40)]
    now = [f"c{k}" for k in range(300)]
    for k in range(30):
        rows.append((2000 + k, " ".join(now)))
        now = edited(rng, now, 3).split(" ")
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell=cell) == by_contract(rows)


def test_edges(spark, sample, nothing):
    rows = [(r.doc_id, r.text) for r in sample.collect()] + [(50, "Five Words are Not many"), (51, "five words are not MANY"), (52, "a b"), (53, "A  b"), (None, "a b"), (54, None)]
    docs = sample.unionByName(spark.createDataFrame(rows[len(rows) - 6 :], "doc_id long, text string"), allowMissingColumns=True)
    assert found(docs) == by_contract(rows)
    assert M.near_duplicates(nothing).collect() == []
