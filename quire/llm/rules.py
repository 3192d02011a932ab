"""Quality rules: a learned decision list over text statistics, in native expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, long_rows

WINDOW, MIN_WORDS, REPEATED_PERCENT = 5, 10, 20
#: At most so many labelled rows are used to learn the list.
SAMPLE = 20_000
BLANKS = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

#: What rules may test: shares and counts that follow from the statistics.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeated_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "distinct_share": "n_distinct / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "marks_per_word": "n_marks / n_words",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics of every whole text, and further ones for the
    rules, all long. A null text has no words. Built-in functions only.

    Repeats of five-word windows are found by the windows' 64-bit hashes: sorted
    with their places, neighbours of equal hash mark the places that repeat, and
    a scan over these adds up the words covered. Texts without a repeat, nearly
    all, skip that. No lambda reads a column from outside, so a filter that is
    pushed down can't make a step run once for each word."""
    d = long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(
        "doc_id",
        F.filter(F.split("t", BLANKS), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(TRIM)) != "").alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("t", F.lit(r"[!?.,;:]")).cast("long").alias("n_marks"),
    )
    size = lambda c: F.size(c).cast("long")
    d = d.select(
        "doc_id", "n_symbols", "n_upper", "n_digits", "n_marks",
        size("w").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        size("lines").alias("n_lines"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        size(F.array_distinct("w")).alias("n_distinct"),
        F.transform(F.arrays_zip(*(F.slice("w", k, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))) for k in range(1, WINDOW + 1))), lambda x: F.xxhash64(*(x[str(k)] for k in range(WINDOW)))).alias("h"),
    )
    d = d.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    placed = F.when(F.col("repeats"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("s", placed).drop("h")
    none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))
    flags = F.zip_with("s", F.concat(none, F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0)))), lambda x, p: F.struct(x["h"].alias("h"), x["i"].alias("i"), x["h"].eqNullSafe(p["h"]).alias("same")))
    flags = F.zip_with(flags, F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(0))), lambda x, n: F.struct(x["i"].alias("i"), (x["same"] | x["h"].eqNullSafe(n["h"])).alias("same")))
    starts = F.sort_array(F.transform(F.filter(flags, lambda x: x["same"]), lambda x: x["i"]))
    d = d.withColumn("starts", F.when(F.col("repeats"), starts)).drop("s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "starts", start,
        lambda a, i: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(a["upto"] - i, F.lit(0))).cast("long").alias("n"), (i + WINDOW).alias("upto")),
        lambda a: a["n"],
    )
    return d.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long")).drop("starts", "repeats")


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words")


def _feature(name: str) -> Column:
    """A share's value; a share of nothing is 0."""
    return F.expr(f"coalesce(try_divide({' , '.join(FEATURES[name].split(' / '))}), 0d)") if "/" in FEATURES[name] else F.col(FEATURES[name]).cast("double")


@dataclass(frozen=True)
class Rule:
    """All of the tests (feature, above, threshold) hold: the text is rejected."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    support: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & (_feature(name) > at if above else _feature(name) <= at)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.tests:
            out &= x[name] > at if above else x[name] <= at
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.4g}" for n, a, t in self.tests)


def _gain(pos: np.ndarray, neg: np.ndarray, pos0: float, neg0: float) -> np.ndarray:
    """FOIL's information gain of narrowing a rule from (pos0, neg0) to (pos, neg)."""
    return np.where(pos > 0, pos * (np.log2((pos + 1e-9) / (pos + neg + 1e-9)) - np.log2((pos0 + 1e-9) / (pos0 + neg0 + 1e-9))), -1.0)


def _best_test(x: dict, y: np.ndarray) -> tuple | None:
    """The test with the highest gain over the rows given, of all that tell two values
    apart (of equal ones the first feature's, `<=` before `>`, the lowest threshold);
    y is 1 where rejected."""
    best, pos0, neg0 = (1e-6, None), y.sum(), (1 - y).sum()
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, upto = v[order], np.cumsum(y[order])
        cuts = np.flatnonzero(s[1:] > s[:-1])
        p = upto[cuts].astype(float)
        n = cuts + 1 - p
        for above, gains in ((False, _gain(p, n, pos0, neg0)), (True, _gain(pos0 - p, neg0 - n, pos0, neg0))):
            if len(cuts) and (g := float(gains.max())) > best[0]:
                c = int(cuts[gains.argmax()])
                best = g, (name, above, float((s[c] + s[c + 1]) / 2))
    return best[1]


def learn(x: dict[str, np.ndarray], y: np.ndarray, least_precision: float = 0.75, least_support: int = 3, most_rules: int = 12, most_tests: int = 4, seed: int = 5) -> list[Rule]:
    """Sequential covering. Two thirds of the rows not yet covered grow a
    conjunction, test by test, for the rejected class; the other third prunes it
    from the end where that raises (p - n) / (p + n). A rule stays in the list if
    its precision over all uncovered rows is high enough; rows it covers are set
    aside. The list ends when a rule fails."""
    rng, rules = np.random.default_rng(seed), []
    left, failures = np.arange(len(y)), 0
    while len(rules) < most_rules and y[left].sum() >= least_support and failures < 3:
        mix = rng.permutation(left)
        grow, prune = mix[: 2 * len(mix) // 3], mix[2 * len(mix) // 3 :]
        tests: list[tuple] = []
        rows = grow
        while len(tests) < most_tests and 0 < y[rows].sum() < len(rows):
            test = _best_test({k: v[rows] for k, v in x.items()}, y[rows])
            if test is None:
                break
            tests.append(test)
            rows = rows[Rule((test,), 0, 0).holds({k: v[rows] for k, v in x.items()})]
        if not tests:
            break

        def worth(k, at=prune):
            hit = at[Rule(tuple(tests[:k]), 0, 0).holds({n: v[at] for n, v in x.items()})]
            p = y[hit].sum()
            return (2 * p - len(hit)) / len(hit) if len(hit) else -1.0

        scores = [worth(k) for k in range(1, len(tests) + 1)]
        tests = tests[: int(np.argmax(scores)) + 1]
        held = Rule(tuple(tests), 0, 0).holds({k: v[left] for k, v in x.items()})
        p, n = int(y[left[held]].sum()), int(held.sum())
        if n < least_support or p / n < least_precision:
            failures += 1
            continue
        rules.append(Rule(tuple(tests), p / n, n))
        left = left[~held]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mod: int = 5, fold: int = 0) -> list[Rule]:
    """Learn the list from at most `sample` labelled rows, taken in the order of a
    hash of doc_id, outside the held-out fold, and passing the base checks. Only
    statistics of these rows reach the driver."""
    key = F.col("doc_id").cast("long")
    chosen = labels.where("quality is not null and doc_id is not null").where(crc_mod(key, mod) != fold).select(key.alias("_id"), F.col("quality").cast("int").alias("_bad"))
    chosen = chosen.groupBy("_id").agg(F.max(1 - F.col("_bad")).alias("_bad")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("_id")), F.col("doc_id") == F.col("_id"), "left_semi"))
    rows = stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_bad", base_failed().alias("_failed"), *[_feature(n).alias(n) for n in FEATURES]).collect()
    rows = [r for r in rows if not r["_failed"]]
    if not rows:
        return []
    rows.sort(key=lambda r: (r["doc_id"], *[r[n] for n in FEATURES]))
    return learn({n: np.array([r[n] for r in rows], float) for n in FEATURES}, np.array([r["_bad"] for r in rows], int))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule (1.. of the rule that rejected; 0: none) for every text.

    A null or empty text has no words and fails the base checks; texts of any length
    are taken whole; an empty table gives no rows. Every row is judged on its own, so
    repeated rows give repeated results; doc_id may be null. Of several rules that
    hold the first counts.
    Without rules all that pass the base checks are kept. Extra columns are
    ignored. The verdict is one ordered conditional expression; nothing is
    shuffled and no Python runs on executors."""
    which = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        which = F.when(rule.column(), F.lit(k)).otherwise(which)
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(which))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
