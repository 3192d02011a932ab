import re
from collections import Counter

import numpy as np

from quire.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def check(df, rules=()):
    want = sorted(str((r.doc_id, *brute(r.text))) for r in df.select("doc_id", "text").collect())
    rows = R.judge(df, list(rules)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows) == want
    assert all(not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r["rule"] == 0) for r in rows)
    return rows


def test_statistics(documents):
    check(documents)


def test_edge_cases(spark, sample, nothing):
    check(sample)
    assert R.judge(nothing, []).count() == 0
    tricky = ["a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a a", "a\x0bb\x0cc d\x1ce", "x\n\nx\n \nx\r\nx", "é#*$%&|<>", " lead", "日 本 " * 9]
    check(spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string"))


def test_a_filter_above_does_not_change_results(documents):
    out = R.judge(documents, [])
    assert out.where("n_repeat_words > 3 and kept").count() == sum(r.n_repeat_words > 3 and r.kept for r in out.collect())


def test_learning_finds_planted_conjunctions():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    y = ((x["a"] > 0.7) & (x["b"] <= 0.4) | (x["c"] > 0.95)).astype(int)
    found = R.learn(x, y)
    verdict = np.any([r.holds(x) for r in found], axis=0)
    assert (verdict == (y == 1)).mean() > 0.99 and len(found) <= 6
    assert all(len(r.tests) <= 4 and " and " in f"{r} and " for r in found)


def test_noise_gives_no_rules():
    rng = np.random.default_rng(4)
    x = {"a": rng.random(2000)}
    assert R.learn(x, (rng.random(2000) < 0.1).astype(int)) == []


def test_learned_list_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = R.fit(docs, labels)
    rows = R.judge(docs, rules).join(labels, "doc_id").where("not base_failed and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.97
    assert R.fit(docs, labels.limit(0)) == [] and R.fit(docs.limit(0), labels) == []


def test_the_plan_is_native(documents):
    plan = R.judge(documents, [R.Rule((("symbols_per_word", True, 0.5),), 1.0, 9)])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
