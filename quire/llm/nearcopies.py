"""Near copies by resemblance, for filtering stages: SimHash anchors and bands of minima.

SimHash fingerprints under anchor covering (`simhash`) find texts whose fingerprints
differ in 2 bits. Five-word shingle sets with a Jaccard similarity of 0.8 differ in about
10 bits of 64, at times in 18, which no covering of affordable size reaches. So the
anchors give what they can, the bands of SuperMinHash signatures (`minhash`) give the
rest, and the exact similarity of the sets decides on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

from . import minhash
from .common import long_rows, lookup, small, without_rows
from .resemblance import SIMILARITY, WORDS
from .simhash import links


def anchored(sets: DataFrame) -> DataFrame:
    """sets: a row for each different set. u, v: sets whose SimHash fingerprints differ in 2
    bits at most, as links that connect these."""
    by_fp = sets.groupBy("simhash").agg(F.min("set").alias("first"), F.count("*").alias("n"))
    covered = links(sets.select(F.col("simhash").alias("fp")).distinct())
    low, high = by_fp.select(F.col("simhash").alias("u"), F.col("first").alias("a")), by_fp.select(F.col("simhash").alias("v"), F.col("first").alias("b"))
    between = covered.join(low, "u").join(high, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    equal = sets.join(by_fp.where("n > 1"), "simhash").where("set <> first").select(F.col("set").alias("u"), F.col("first").alias("v"))
    return between.unionAll(equal)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, cell: int = minhash.CELL) -> DataFrame:
    """docs without the rows that another of their group stands for. Texts are linked
    if their sets of `words`-word shingles (A-Z lower-cased) have a Jaccard similarity
    of at least `similarity`; a group is what links reach. A link is missed where all
    bands of its signatures miss it: at 0.8 five times in 10**8.

    Of a group the row with the smallest doc_id stays (of equal ones that with the
    smallest text hash; rows without a doc_id come last), with all its repeats: it is
    decided by doc_id and text, not by doc_id alone. Texts without words (null,
    empty) are one group. Texts of any length are taken whole. Empty table: no rows.
    `cell` affects the work, not the result. Columns stay as they are, whatever their
    names."""
    seen = materialize(minhash.sketches(docs, words, anchors=True), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = materialize(seen.groupBy("set").agg(F.min("row").alias("row"), F.min(rank).alias("own")), "first")
    one = small(first.select("row"))
    sets = materialize(seen.where("n > 0").select("set", "row", "fp", "low", "cells", "n", "parity", "simhash").join(one, "row", "left_semi"), "sets")
    roots = minhash.classes(docs, seen, sets, words, similarity, cell, anchored(sets))
    grouped = first.join(roots, first["set"] == roots["node"], "left").select("set", "own", F.coalesce("root", "set").alias("root"))
    best = grouped.groupBy("root").agg(F.min("own").alias("best"))
    kept = materialize(grouped.join(best, "root").select("set", "best.doc_id", "best.h").toDF("set", "first_id", "first_h"), "kept")
    rows = lookup(seen.select("doc_id", "h", "set"), kept, ["set"], ["h"])
    gone = rows.where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))))
    return without_rows(long_rows(docs), materialize(gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "gone", even=True))
