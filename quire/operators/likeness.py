"""How alike two texts are: what share of their characters or words is common, in order.

Short pairs are decided whole. Long ones are cut where both texts have the same stretch,
once in each: a join finds such anchors, the longest chain that runs forward in both is
kept, and what lies between is compared piece by piece, wherever there is room."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

#: Characters of an anchor, and of so many stretches one is tried as an anchor.
ANCHOR, TRIED = 16, 4
#: Pairs whose lengths have no larger product are not cut.
WHOLE = 1 << 24


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence: a bit for each character of the longer
    text, all looked at together for each character of the other."""
    if len(x) > len(y):
        x, y = y, x
    at: dict[str, int] = {}
    for k, c in enumerate(y):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(y)) - 1
    v = full
    for c in x:
        if m := at.get(c, 0) & v:
            v = (v + m | v - m) & full
    return len(y) - v.bit_count()


def _stretches(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the stretches of ANCHOR characters that occur once, of which the hash
    chooses some."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - ANCHOR + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ANCHOR):
            h = (h ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    own, first, times = np.unique(h, return_index=True, return_counts=True)
    keep = (times == 1) & (own % np.uint64(TRIED) == 0)
    return own[keep].view(np.int64), first[keep].astype(np.int64)


def _anchors(pairs: DataFrame, side: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0), b.column(1).to_pylist()):
                h, at = _stretches(text)
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(h)), pa.array(h), pa.array(at)], ["id", "h", side])

    return pairs.select("id", "x" if side == "p" else "y").mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, h long, {side} long")


def _forward(p: list[int], q: list[int]) -> list[int]:
    """Places of the longest chain that grows in q (p grows already), without overlap."""
    ends, last, before = [], [], [-1] * len(q)
    for k, v in enumerate(q):
        at = bisect_left(ends, v)
        before[k] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(v)
            last.append(k)
        else:
            ends[at], last[at] = v, k
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    kept: list[int] = []
    for k in reversed(chain):
        if not kept or p[k] >= p[kept[-1]] + ANCHOR and q[k] >= q[kept[-1]] + ANCHOR:
            kept.append(k)
    return kept


def _chains(anchors: DataFrame) -> DataFrame:
    """id, cuts: the anchors of each pair that are kept, in order."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.column(1).to_pylist():
                p, q = [a["p"] for a in row], [a["q"] for a in row]
                out.append([{"p": p[k], "q": q[k]} for k in _forward(p, q)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("p", pa.int64()), ("q", pa.int64())])))], ["id", "cuts"])

    held = anchors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("a"))
    return held.mapInArrow(run, f"id {anchors.schema['id'].dataType.simpleString()}, cuts array<struct<p: long, q: long>>")


def _pieces(cut: DataFrame) -> DataFrame:
    """id, k, x, y: what lies between the cuts of each pair, where it differs; and a row
    without x, whose `common` is the length of all else that is the same."""

    def run(batches):
        for b in batches:
            for key, x, y, cuts in zip(b.column(0), *(b.column(c).to_pylist() for c in (1, 2, 3))):
                i = j = n = 0
                found = []
                for a in [*cuts, {"p": len(x), "q": len(y)}]:
                    u, v = x[i : a["p"]], y[j : a["q"]]
                    if u == v:
                        n += len(u)
                    elif u and v:
                        found.append((u, v))
                    i, j = a["p"] + ANCHOR, a["q"] + ANCHOR
                    n += ANCHOR
                columns = [pa.repeat(key, len(found) + 1), pa.array(range(len(found) + 1)), pa.array([u for u, _ in found] + [None], pa.string()), pa.array([v for _, v in found] + [None], pa.string()), pa.array([None] * len(found) + [n - ANCHOR], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "k", "x", "y", "common"])

    return cut.select("id", "x", "y", "cuts").mapInArrow(run, f"id {cut.schema['id'].dataType.simpleString()}, k long, x string, y string, common long")


def _compared(pieces: DataFrame) -> DataFrame:
    """id, common of pieces (id, x, y)."""

    def run(batches):
        for b in batches:
            n = [common_length(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "common"])

    return pieces.select("id", "x", "y").mapInArrow(run, f"id {pieces.schema['id'].dataType.simpleString()}, common long")


def common(pairs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """id, n, m, common: lengths of x and y, and of their longest common subsequence; for
    pairs with n * m over `whole` that of the subsequences through their anchors, which is
    at most that and exact for texts that differ in places only. pairs: id (unique), x, y.
    Nulls are empty texts; equal texts are not compared."""
    own = pairs.select("id", F.coalesce("x", F.lit("")).alias("x"), F.coalesce("y", F.lit("")).alias("y"))
    own = own.withColumn("n", F.char_length("x").cast("long")).withColumn("m", F.char_length("y").cast("long"))
    differ = (F.col("x") != F.col("y")) & (F.col("n") > 0) & (F.col("m") > 0)
    apart = own.where(differ & (F.col("n") * F.col("m") <= whole))
    long = own.where(differ & (F.col("n") * F.col("m") > whole))
    met = _anchors(long, "p").join(_anchors(long, "q"), ["id", "h"]).select("id", "p", "q")
    cut = long.join(_chains(met), "id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<p: long, q: long>>")))
    pieces = materialize(_pieces(cut), "pieces")
    same = pieces.where("x is null").select("id", "common")
    # dealt anew: pieces of one pair of very long texts are work for many tasks
    between = pieces.where("x is not null").repartition(F.col("id"), F.col("k"))
    found = _compared(apart).unionAll(_compared(between)).unionAll(same).unionAll(own.where(~differ).select("id", F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).cast("long").alias("common")))
    return own.select("id", "n", "m").join(found.groupBy("id").agg(F.sum("common").alias("common")), "id")


def likeness(pairs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """id, likeness: twice the common length over the sum of both; 1 for two empty texts."""
    both = F.col("n") + F.col("m")
    return common(pairs, whole).select("id", F.when(both == 0, 1.0).otherwise(2 * F.col("common") / both).alias("likeness"))


def collapsed(c: Column) -> Column:
    """White space at the ends gone, and runs of it one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def as_words(pairs: DataFrame) -> DataFrame:
    """id, x, y with a character for each word, the same for the same words of a pair."""

    def run(batches):
        for b in batches:
            made = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                numbers: dict[str, str] = {}
                one = lambda w: numbers.setdefault(w, chr(0xE000 + len(numbers)))  # noqa: B023, E731
                made.append(["".join(map(one, t.split())) for t in (x or "", y or "")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], ["id", "x", "y"])

    return pairs.select("id", "x", "y").mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, x string, y string")


def accuracy(pairs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """id, char_accuracy, word_error_rate of a text got (x) and the one wanted (y): the share
    of characters that is common, and of words that is not, white space collapsed. Only
    texts that differ are written and compared."""
    both = pairs.select("id", collapsed(F.col("x")).alias("x"), collapsed(F.col("y")).alias("y")).withColumn("same", F.col("x") == F.col("y"))
    plain = materialize(both.select("id", *(F.when(~F.col("same"), F.col(c)).alias(c) for c in ("x", "y")), "same"), "plain")
    same = plain.where("same").select("id", F.lit(1.0).alias("char_accuracy"), F.lit(0.0).alias("word_error_rate"))
    differ = plain.where("not same").select("id", "x", "y")
    if differ.isEmpty():
        return same
    chars = likeness(differ, whole).withColumnRenamed("likeness", "char_accuracy")
    words = likeness(as_words(differ), whole).select("id", (1 - F.col("likeness")).alias("word_error_rate"))
    return same.unionByName(chars.join(words, "id"))
