import itertools
import math
import random

from quire.llm import tokencount as T


def brute(model, word):
    """Score and tokens of the best of all segmentations, looked at one by one. Of equal
    scores the one with the shorter last piece counts, then the one before it."""
    best = None
    for cuts in itertools.product((False, True), repeat=max(0, len(word) - 1)):
        edges = [0, *(k + 1 for k, cut in enumerate(cuts) if cut), len(word)]
        score, tokens = 0.0, 0
        for a, b in zip(edges, edges[1:]):
            piece = word[a:b]
            if piece in model.score and (len(piece) > 1 or model.score[piece] > len(piece.encode()) * model.byte):
                score, tokens = score + model.score[piece], tokens + 1
            elif len(piece) == 1:
                score, tokens = score + len(piece.encode()) * model.byte, tokens + len(piece.encode())
            else:
                break
        else:
            key = (score, [-(b - a) for a, b in zip(edges[-2::-1], edges[:0:-1])])
            if best is None or key > best[0]:
                best = key, tokens
    return best[0][0], best[1]


def test_trie_counts_as_brute_force():
    model, rng = T.Unigram.load(T.default_vocabulary()), random.Random(2)
    words = {T.SPACE + "".join(rng.choice("abcdefghinrst日é") for _ in range(rng.randrange(1, 10))) for _ in range(250)} | {T.SPACE}
    counts = T.count_words(model, words)
    assert set(counts) == words
    for w in words:
        score, n = brute(model, w)
        forward, count = [0.0], [0]
        model.extend(w, forward, count)
        assert math.isclose(forward[-1], score, rel_tol=1e-9) and counts[w] == n


def test_long_words_go_on_from_the_trie(monkeypatch):
    model, rng = T.Unigram.load(T.default_vocabulary()), random.Random(3)
    words = {T.SPACE + "".join(rng.choice("theandquick日") for _ in range(n)) for n in (63, 64, 65, 66, 130, 700) for _ in range(3)}
    words |= {w[:70] + "x" for w in words}
    forward = lambda w: model.count(w) if len(w) < T.PART else None
    want = {w: forward(w) for w in words}
    for part in (1, 5, 4096):
        monkeypatch.setattr(T, "PART", part)
        assert T.count_words(model, words) == want
    assert T.count_words(model, {"x" * 300_000})["x" * 300_000] > 1000


def test_shared_prefixes_are_scored_once():
    calls = []

    class Counting(T.Unigram):
        def extend(self, text, forward, count):
            calls.append(len(text) + 1 - len(forward))
            super().extend(text, forward, count)

    T.count_words(Counting(["a", "b", "ab"]), {"abab", "abaa", "ab"})
    assert sum(calls) == 5  # a, b, a, b, a


def test_given_scores():
    model = T.Unigram(["a", "b", "ab"], [-1.0, -1.0, -2.5])
    assert model.count("ab") == 2 and T.Unigram(["a", "b", "ab"], [-1.0, -1.0, -1.5]).count("ab") == 1
    assert model.count("é") == 2


def check(df):
    model = T.Unigram.load(T.default_vocabulary())
    want = sorted(str((r.doc_id, len((r.text or "").split()), sum(model.count(T.SPACE + w) for w in (r.text or "").split()))) for r in df.select("doc_id", "text").collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_tokens)) for r in T.token_counts(df, slice_rows=7).collect()) == want


def test_documents(documents):
    check(documents)


def test_edge_cases(sample, nothing):
    check(sample.where("doc_id is null or doc_id <> 9"))
    assert {r.n_words for r in T.token_counts(sample.where("doc_id = 9")).collect()} == {1}
    assert T.token_counts(nothing).count() == 0
