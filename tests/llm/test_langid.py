import zlib

import numpy as np

from quire.llm import langid as L


def test_bundle_is_the_sum_of_bound_letters():
    s = L.Space(256, 3)
    a, b, c = (s.letters[ord(x)].astype(int) for x in "abc")
    space = s.letters[32].astype(int)
    want = np.roll(space, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * c + np.roll(b, 2) * np.roll(c, 1) * space
    assert (s.bundle("ABc") == want).all()
    assert s.bundle("12 3!") is None and s.bundle("") is None
    assert (s.bundle("ab  --  c") == s.bundle("ab c")).all()


def test_chunks_of_a_long_text_run_into_each_other():
    s = L.Space(64, 1)
    for text in ("abc  def -- ghi. " * 8, "", "?", "x", " ab", "ΑΣ ΣΑΣ." * 9):
        want = s.bundle(text)
        for chunk in (1, 2, 3, 7, 16, 31):
            got = s.bundle(text, chunk)
            assert (got is None and want is None) or (got == want).all()
    text = "abc def " * 80_000
    assert (s.bundle(text) == s.bundle(text, 1 << 24)).all()


def brute(text, dim=L.DIM, seed=L.SEED):
    """The bundle letter by letter."""
    letter = lambda c: (np.random.default_rng([seed, ord(c)]).integers(0, 2, dim, np.int8) * 2 - 1).astype(int)
    t = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    t = " ".join(["", *t.split(), ""])
    if not t.strip():
        return None
    return sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(t, t[1:], t[2:]))


def test_predictions_by_brute_force(spark, documents):
    docs = documents.where("length(text) < 600").limit(40).select("doc_id", "text", "lang")
    rows = docs.collect()
    sums = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and (v := brute(r.text)) is not None:
            sums[r.lang] = sums.get(r.lang, 0) + v
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(df, L.fit(df)).collect()}
    for r in rows:
        v = brute(r.text)
        if v is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        cos = {k: float(v @ s) / np.linalg.norm(v) / np.linalg.norm(s) for k, s in sorted(sums.items())}
        assert got[r.doc_id].lang_pred == max(cos, key=cos.get) and abs(got[r.doc_id].score - min(1, max(0, max(cos.values())))) < 1e-6


def test_what_resembles_no_language_goes(spark):
    words = "the quick brown fox jumps over a lazy dog and runs home again every day".split()
    docs = spark.createDataFrame([(k, " ".join(words[k % 7 :] + words[: k % 5]), "en") for k in range(40)] + [(100, "\u4e00\u9fa5\u7684" * 3, None), (101, "zqxv wvzq qqzx jvwq", None), (102, "dog", None), (None, "the fox", None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in L.keep_known(docs, L.fit(docs)).collect()}
    assert kept >= set(range(40)) | {102, None} and not kept & {100, 101}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(sample, nothing):
    p = L.fit(sample)
    out = {(r.doc_id, r.lang_pred, r.score) for r in L.identify(sample, p).collect()}
    und = {i for i, lang, _ in out if lang == "und"}
    assert {2, 3, 4, 5} <= und and 0 not in und and 11 not in und
    assert L.identify(nothing, p).count() == 0
    empty = L.fit(nothing)
    assert empty.langs == [] and {r.lang_pred for r in L.identify(sample, empty).collect()} == {"und"}
    kept = L.keep_known(sample, p)
    assert kept.columns == sample.columns and {2, 3, 4, 5}.isdisjoint(r.doc_id for r in kept.collect())
