"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

#: So many narrow rows are broadcast (counted first); more are joined by their key.
BROADCAST = 1 << 20
#: Rows with one key that are joined in one place.
HEAVY = 1 << 16


def small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """df, which is written, to be broadcast in a join if it has no more than `rows`
    rows; else to be merged, whatever its size is thought to be."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def dealt(rows: DataFrame, of: DataFrame, keys: list[str], by: list[str], heavy: int = HEAVY, limit: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """rows and `of` with a column `_part` more, to be joined by keys and it: rows of keys
    that more than `heavy` rows have are dealt by the columns `by`, and what `of` has for
    such a key stands in each part."""
    many = rows.groupBy(*keys).count().where(F.col("count") > heavy).select(*keys, F.ceil(F.col("count") / heavy).cast("int").alias("_parts"))
    many = small(materialize(many, "many"), limit)
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(many, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    right = of.join(many, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left, right


def lookup(rows: DataFrame, of: DataFrame, keys: list[str], by: list[str], heavy: int = HEAVY, limit: int = BROADCAST) -> DataFrame:
    """rows with the columns that `of` (written, one row a key) has for their key, null where
    it has none. `of` is broadcast if it is small; else heavy keys are dealt."""
    if of.count() <= limit:
        return rows.join(F.broadcast(of), keys, "left")
    left, right = dealt(rows, of, keys, by, heavy, limit)
    return left.join(right.hint("merge"), [*keys, "_part"], "left").drop("_part")


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, first: str, last: str, rank: str, heavy: int = HEAVY, limit: int = BROADCAST) -> DataFrame:
    """points with the other columns of the range that holds them: of those with the same
    keys and first <= point <= last (all longs) the one of least rank; null if none does.

    A range of up to 2**k numbers lies in one or two bins of 2**k; it goes to these, and a
    point to its bin of each size that occurs (64 at most): an equi-join, and the exact
    test after it. Only different points are joined, and bins that many of them fall
    into are dealt; their ranges are copied to each part. A range that ends before it
    starts holds nothing."""
    values = [c for c in ranges.columns if c not in {*keys, first, last}]
    span = F.col(last) - F.col(first)
    level = F.when(span == 0, 0).otherwise(F.length(F.bin(span))).cast("int")
    cut = ranges.where(span >= 0).withColumn("_level", level)
    bins = F.array_distinct(F.array(F.expr(f"shiftright({first}, _level)"), F.expr(f"shiftright({last}, _level)")))
    cut = cut.withColumn("_bin", F.explode(bins))
    levels = [r[0] for r in cut.select("_level").distinct().collect()]
    asked = points.select(*keys, point).where(F.col(point).isNotNull()).distinct()
    asked = asked.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bin", F.expr(f"shiftright({point}, _level)"))
    at = [*keys, "_level", "_bin"]
    left, right = dealt(asked, cut, at, [point], heavy, limit)
    held = left.join(right, [*at, "_part"]).where((F.col(first) <= F.col(point)) & (F.col(point) <= F.col(last)))
    best = held.groupBy(*keys, point).agg(F.min_by(F.struct(first, last, *values), F.col(rank)).alias("_r")).select(*keys, point, "_r.*")
    return lookup(points, materialize(best, "best"), [*keys, point], [c for c in points.columns if c not in {*keys, point}] or [point], heavy, limit)
