"""Folds over arrays in a row, in time proportional to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that are added up together.
BLOCK = 256


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def fixed(c: Column) -> Column:
    """c, computed where it stands and once. The optimizer puts the expression behind a
    column into filters above it and into what else refers to it, lambdas too, and
    folds over folds would grow without end; it leaves alone what isn't
    deterministic, so the value hangs on a random number that is always large enough. (On a
    sum, as the optimizer knows what comparing a random number alone with zero gives.)"""
    return F.when(F.rand(0) + 1.0 >= 1.0, c)


def positions(items: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) of the items after which the state, a struct, has a true `new`.
    `items` names a column that is `fixed` or read.

    A fold copies what it holds at each item. So a block of items is folded by itself,
    from the state that the block before left, and holds its own places only; the fold
    over blocks holds the lists of places that are done. `last` is what the block just
    folded gave: it is added to the lists one block later, so that it is made once."""
    n = F.size(items)
    none = F.array().cast("array<int>")

    def one(a, x):
        s = step(a["s"], x)
        return F.struct(s.alias("s"), (a["i"] + 1).alias("i"), F.when(s["new"], F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    def block(a, b):
        own = F.struct(a["last"]["s"].alias("s"), (b * BLOCK).alias("i"), none.alias("at"))
        return F.struct(F.aggregate(F.slice(F.col(items), b * BLOCK + 1, F.lit(BLOCK)), own, one).alias("last"), F.concat(a["done"], F.array(a["last"]["at"])).alias("done"))

    first = F.struct(F.struct(start.alias("s"), F.lit(0).alias("i"), none.alias("at")).alias("last"), F.array().cast("array<array<int>>").alias("done"))
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(none)
    return F.aggregate(blocks, first, block, lambda a: F.flatten(F.concat(a["done"], F.array(a["last"]["at"]))))


def running(df: DataFrame, items: str, zero: Column, combine: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """df with what `combine`, which associates but need not commute, makes of the items
    (fixed or read) up to each. `zero` is its identity. Blocks are combined by themselves,
    then what the blocks give, then both: no array that is copied at each step is long."""
    n = F.size(items)
    scan = lambda a: F.slice(F.aggregate(a, F.array(zero), lambda so_far, x: F.concat(so_far, F.array(combine(F.element_at(so_far, -1), x)))), F.lit(2), F.size(a))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(F.col(items), b * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.slice(F.array(F.array(zero)), 1, 0))
    df = df.withColumn(f"{out}_in", fixed(blocks))
    df = df.withColumn(f"{out}_upto", fixed(F.concat(F.array(zero), scan(F.transform(f"{out}_in", lambda b: F.element_at(b, -1))))))
    whole = F.transform(f"{out}_in", lambda b, k: F.transform(b, lambda v: combine(F.get(f"{out}_upto", k), v)))
    return df.withColumn(out, fixed(F.flatten(whole))).drop(f"{out}_in", f"{out}_upto")


def states(items: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What `step`, of the state before and an item, makes of each item in turn, from
    `start`. `items` names a column that is `fixed` or read. In blocks, as positions():
    a block goes on from the state that the one before left and holds its own states only."""
    n = F.size(items)
    one = lambda so_far, x: F.concat(so_far, F.array(step(F.element_at(so_far, -1), x)))
    first = F.struct(F.array(start).alias("last"), F.slice(F.array(F.array(start)), 1, 0).alias("done"))

    def block(a, b):
        own = F.aggregate(F.slice(F.col(items), b * BLOCK + 1, F.lit(BLOCK)), F.array(F.element_at(a["last"], -1)), one)
        return F.struct(own.alias("last"), F.concat(a["done"], F.array(a["last"])).alias("done"))

    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, first, block, lambda a: F.flatten(F.transform(F.concat(a["done"], F.array(a["last"])), lambda b: F.slice(b, F.lit(2), F.size(b)))))


def running_sums(df: DataFrame, items: str, out: str) -> DataFrame:
    """df with the sums of the long array `items` (fixed or read) up to each item."""
    return running(df, items, F.lit(0).cast("long"), lambda a, x: a + x, out)


def shifted(items: str) -> Column:
    """The item before each, null for the first."""
    return F.transform(F.col(items), lambda _, i: F.get(F.col(items), i - 1))


def cut(df: DataFrame, items: str, at: Column, make: Callable[[Column], Column], out: str) -> DataFrame:
    """df with an array column `out` more: the array `items` cut at the places `at` (from
    0, which is one), and of each piece what `make` gives. `items` must be the name of a
    column that is `fixed` or read, not an expression: lambdas refer to it."""
    places = f"{out}_at"
    df = df.withColumn(places, fixed(at))
    ends = F.slice(F.concat(F.slice(F.col(places), F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.size(items))), F.lit(1), F.size(places))
    pieces = F.zip_with(F.col(places), ends, lambda a, b: F.slice(F.col(items), a + 1, b - a))
    return df.withColumn(out, fixed(F.transform(pieces, make))).drop(places)


def grouped(df: DataFrame, items: str, starts: Callable[[Column, Column], Column], make: Callable[[Column], Column], out: str) -> DataFrame:
    """cut() where `starts`, of an item and the one before, is true."""
    places = F.transform(F.col(items), lambda x, i: F.when((i == 0) | starts(x, F.get(F.col(items), i - 1)), i))
    return cut(df, items, F.filter(places, lambda i: i.isNotNull()), make, out)
