import itertools
import math
import re

import numpy as np
import pytest
import xxhash

from quire.llm import quality as Q
from quire.llm import toxicity as X


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2) if len(a) and len(b) else 1.0


@pytest.fixture(scope="module")
def small(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = x @ [1, -2, 0, 0.5, 0] + rng.normal(size=60) > 0
    rows, values = [np.arange(5)] * 60, list(x)
    w, b = Q.dual_descent(rows, values, y, 5, np.full(60, 0.5), rounds=2000, tolerance=1e-9)

    def loss(w, b):
        return (w @ w + b * b) / 2 + 0.5 * np.maximum(0, 1 - np.where(y, 1, -1) * (x @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(size=5) * 0.05, b + rng.normal() * 0.05) >= best - 1e-6


def test_ratios():
    r = Q.ratios([np.array([0, 1]), np.array([1])], np.array([True, False]), 3)
    assert r[0] > 0 and r[1] == 0 and r[2] == 0


def test_quality_held_out(small):
    docs, labels = small
    rows = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert auc([r.quality for r in held], [r.score for r in held]) >= 0.97
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_words_without_white_space_are_read_to_their_end():
    x, start = Q.Features(), "日本語のテキスト" * 5
    a, b = (set(x.of(start + end).tolist()) for end in ("です。" * 30, "<a1/>" * 30))
    assert a - b and b - a
    # more than the indicator of the whole word: the shapes of the later parts too
    assert len(a ^ b) > 2
    assert set(x.of(start).tolist()) == set(Q.Features().of(start).tolist()) and len(x.of("x" * 200_000)) < 20


def indicators(text):
    """The indicators of a text of short words, by their definition."""
    words = text.split()
    runs = lambda w: re.sub(r"[A-Z]+|[a-z]+|[0-9]+|(.)\1*", lambda m: "A" if m[0][0].isupper() else "a" if m[0].isalpha() else "9" if m[0].isdigit() else m[0][:3], w)
    shapes = [runs(w) for w in words]
    names = {"w" + w.lower() for w in words}
    names |= {"g" + "\0".join(shapes[k : k + n]) for n in (2, 3) for k in range(len(shapes) - n + 1)}
    power = lambda n: (len(words) // n).bit_length() if n else -1
    names |= {f"s{x}/{power(shapes.count(x))}" for x in shapes}
    if words:
        names.add(f"s=/{power(sum(a == b for a, b in zip(words, words[1:])))}")
    return {xxhash.xxh64_intdigest(n) & (1 << Q.BITS) - 1 for n in names}


def test_indicators_by_their_definition():
    for text in ("", "One two TWO 12ab ab12 !!!! a-b a-b", "x " * 40 + "End. ###", "same same same other Same"):
        assert set(Q.Features().of(text).tolist()) == indicators(text)


def test_parts_of_long_texts_run_into_each_other(monkeypatch):
    text = "One two 33 four, five! five! six7 8 nine-ten Eleven eleven eleven 12 !! thirteen"
    want = indicators(text)
    for part in (1, 2, 3, 5, 7):
        monkeypatch.setattr(Q, "PART", part)
        assert set(Q.Features().of(text).tolist()) == want


def test_scores_by_dense_algebra(spark):
    """The margin as dense algebra has it: indicators times log ratios, to length 1."""
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(rng.choice(["good", "fine", "text", "##", "buy", "now"], 12, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1] if k % 2 else [0.1, 0.1, 0.2, 0.2, 0.2, 0.2]))) for k in range(120)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    model = Q.fit(df, labels)
    got = {r.doc_id: r.score for r in Q.score(df, model).collect()}
    for k, text in docs:
        x = np.zeros(1 << Q.BITS)
        x[list(indicators(text))] = 1
        x *= model.scale
        z = model.slope * (x @ model.weights / np.sqrt(x @ x) + model.bias) + model.offset
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert auc([k % 2 for k in got], list(got.values())) > 0.85


def test_the_sample_is_bounded_in_bytes(spark):
    df = spark.createDataFrame([(k, k % 2, b"x" * 1000) for k in range(40)], "id long, y int, found binary")
    got = Q.gathered(df, 5_500)
    assert sorted(y for _, y, _ in got) == [0] * 5 + [1] * 5 and got == Q.gathered(df.repartition(3), 5_500)
    assert len(Q.gathered(df)) == 40


def test_toxicity_held_out(small):
    docs, labels = small
    rows = X.score(docs, X.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert auc([r.toxic for r in held], [r.score for r in held]) >= 0.85
    assert np.mean([r.predicted for r in held if r.toxic == 0]) <= 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("op", [Q, X])
def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(op, spark, small):
    docs, labels = small
    some = docs.where("doc_id < 300")
    turned = labels.selectExpr("doc_id", *(f"if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - {c}, {c}) as {c}" for c in ("quality", "toxic")))
    bare = some.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source")
    a = {r.doc_id: r.score for r in op.score(some, op.fit(some, labels)).collect()}
    b = {r.doc_id: r.score for r in op.score(bare, op.fit(bare, turned)).collect()}
    assert a == b


@pytest.mark.parametrize("op", [Q, X])
def test_edge_cases(op, spark, sample, nothing, labels):
    none = labels.limit(0)
    for docs, marks in ((sample, none), (nothing, none), (nothing, labels), (sample, labels)):
        rows = op.score(sample, op.fit(docs, marks)).collect()
        assert len(rows) == sample.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
        assert all(not r.held_out for r in rows if r.doc_id is None)
    odd = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, None, None), (None, 1, 1), (7, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert op.score(sample, op.fit(sample, odd)).count() == sample.count()


@pytest.fixture(scope="module")
def restorer():
    words = "you are an idiot and a loser or a moron so stupid as it is with all the trash of this place".split()
    classes, counts = X.letter_classes(), np.zeros(X.N**3, np.int64)
    for w in words:
        c = np.concatenate([[0, 0], classes[[ord(x) for x in w]], [0, 0]])
        counts += np.bincount((c[:-2] * X.N + c[1:-1]) * X.N + c[2:], minlength=X.N**3)
    return X.Restorer(X.CharModel.of(counts * 50))


@pytest.mark.parametrize("shown, word", [("1d10t", "idiot"), ("idi0t!", "idiot"), ("l0s3r", "loser"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("m*ron", "moron"), ("TR@SH", "trash")])
def test_disguises(restorer, shown, word):
    assert word in restorer.parts(shown)


@pytest.mark.parametrize("shown, word", [("stuupid", "stupid"), ("idioot", "idiot"), ("!diot", "idiot"), ("*diot,", "idiot"), ("(!diot)", "idiot"), ("s" + "tu" + "u" * 60 + "pid", "stupid"), ("i.d.i.o.t." * 20, "idiot" * 20)])
def test_disguises_that_no_gate_keeps_out(restorer, shown, word):
    assert word in restorer.parts(shown)


def readings(token):
    """All ways to read a token: (letters, log chance of the channel)."""
    bare = not any(map(str.isalpha, token))
    options = []
    for k, c in enumerate(token):
        if c.isalpha():
            own = [(c, X.PLAIN)] + ([("again", X.AGAIN)] if k else [])
        else:
            own = [(x, X.DISGUISED) for x in X.DISGUISES.get(c, "")]
            if not (bare and own):
                own.append(("", X.BETWEEN))
        options.append([(c, *o) for o in own])
    for path in itertools.product(*options):
        out, cost, possible = "", 0.0, True
        for c, letter, price in path:
            cost += price
            if letter == "again":
                possible &= out[-1:] == c
            else:
                out += letter
        if possible:
            yield out, cost


@pytest.mark.parametrize("token", ["1d10t", "stuupid", "l0ser", "@$$", "m*ron", "tr@sh", "i.d.i", "aa", "b00", "s+up1d", "!diot", "x1!"])
def test_viterbi_finds_the_best_of_all_readings(restorer, token):
    def language(word):
        at = [0, 0, *(X._PLACE.get(c, X.N - 1) for c in word), 0]
        return sum(float(restorer.logp[a, b, c]) for a, b, c in zip(at, at[1:], at[2:]))

    total = {}
    for word, cost in readings(token):
        total[word] = max(total.get(word, -math.inf), cost + language(word))
    got = restorer._decode(token)
    assert total[got] == pytest.approx(max(total.values()))


def test_scores_follow_from_the_words(restorer):
    texts = ["you 1d10t", "i d i o t now, stuupid", "", "*** 12", "plain words here", "an idiot. m*ron! l0s3r"]
    weights = {k: (0.3 if n % 2 else -0.2) + n / 100 for n, k in enumerate(sorted({k for t in texts for w in restorer.words(t) for k in X.names(w)}))}
    of = X.Model(X.CharModel(restorer.logp), weights, -0.5).scorer()
    for t in texts:
        z = -0.5 + sum(weights[k] for k in {k for w in restorer.words(t) for k in X.names(w)})
        assert of(t) == pytest.approx(1 / (1 + math.exp(-z)))


def test_words_of_signs_alone(restorer):
    assert restorer.parts("@$") == ("as",) and restorer.parts("1$") == ("is",)
    assert restorer.parts("***") == restorer.parts("12") == restorer.parts("--") == ()


def test_spaced_words_with_punctuation_and_breaks(restorer):
    assert "idiot" in restorer.words("you: i d i o t.") and "idiot" in restorer.words("(i d i o t), now")
    assert {"you", "are", "an", "idiot"} <= restorer.words("y o u a r e a n i d i o t")
    assert {"you", "idiot"} <= restorer.words(" ".join("youareanidiot" * 5))


def test_long_tokens_take_time_in_proportion(restorer):
    long = "stup1d" * 20_000
    assert len(restorer.parts(long)[-1]) == len(long)


def test_spaced_words_and_plain_text(restorer):
    assert "idiot" in restorer.words("you i d i o t now")
    assert restorer.words("Plain, words (only).") == {"plain", "words", "only"}
    assert restorer.words("") == set() and restorer.words("*** 12 --") == set()
    assert len(restorer.words("a " * 500)) >= 1


def test_character_counts_cover_all(spark):
    df = spark.createDataFrame([(1, "Ab b"), (2, None), (3, "")], "doc_id long, text string")
    assert X.character_counts(df).sum() == (2 + 1) + (1 + 1)  # letters, and the edge after each word


def test_gates_are_open_for_disguises(spark):
    """Figures alone, letters of other scripts, and compatibility forms."""
    docs = spark.createDataFrame([(k, "the stupid man was an ass and the idiot said it again to us in the class of the mass") for k in range(50)], "doc_id long, text string")
    restorer = X.Restorer(X.CharModel.of(X.character_counts(docs)))
    for text, word in (("455", "ass"), ("ідіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("ｓ ｔ ｕ ｐ ｉ ｄ", "stupid"), ("(455),", "ass")):
        assert word in restorer.words(text), text
    for text in ("1999", "the man was an ass", "7"):
        assert restorer.words(text) == {w for w in text.split() if w.isalpha()}
    assert restorer.words("Привет мир") == {"привет", "мир"}
    assert X.plain_letters("naïve") == "naïve" and X.plain_letters("Привет") == "Привет"
