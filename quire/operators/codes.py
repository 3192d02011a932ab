"""Codes of composite fonts as rows, joined with the ranges that give their characters
and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import fixed, grouped
from quire.operators.joins import in_ranges
from quire.session import materialize

FONT = ["doc_id", "page", "font_name"]
#: Ranges of a page's fonts that its codes are looked up in where they are, one after another;
#: longer maps are joined.
IN_ROW = 1024


def code_rows(shown_codes: DataFrame) -> DataFrame:
    """doc_id, page, seq, font_name, place, code: a row for each code shown."""
    return shown_codes.select(*FONT, "seq", F.posexplode("codes").alias("place", "code"))


def _character(code: Column, first: Column, to: Column) -> Column:
    """What a code stands for in a range that starts at `first`, with `to`; its own character
    without a range."""
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    last = F.conv(F.hex(F.encode(F.right(to, F.lit(1)), "UTF-32")), 16, 10).cast("long")
    mapped = F.when((code == first) & (to == "\0"), " ").when(code == first, to).otherwise(char(last + code - first))
    return F.when(to.isNotNull(), mapped).when(code == 0, " ").otherwise(char(code))


def characters(codes: DataFrame, code_maps: DataFrame) -> DataFrame:
    """Code rows with `text`: what the font's maps make of them; a code without a map is its
    own character, and zero is a space."""
    found = in_ranges(codes, code_maps.select(*FONT, "first_code", "last_code", "to", "rank"), FONT, "code", "first_code", "last_code", "rank")
    return found.withColumn("text", _character(F.col("code"), F.col("first_code"), F.col("to"))).drop("first_code", "last_code", "to", "rank")


def widths(codes: DataFrame, font_widths: DataFrame) -> DataFrame:
    """Code rows with `width`, in thousandths of the size: of the first range that holds the
    code, else the font's default (1000 for a font without ranges)."""
    ranges = font_widths.select(*FONT, F.col("first_code").cast("long").alias("first_code"), F.col("last_code").cast("long").alias("last_code"), "width", "rank")
    default = font_widths.groupBy(*FONT).agg(F.first("default_width").alias("default_width"))
    found = in_ranges(codes, ranges, FONT, "code", "first_code", "last_code", "rank").drop("first_code", "last_code", "rank")
    return found.join(default, FONT, "left").withColumn("width", F.coalesce("width", "default_width", F.lit(1000.0))).drop("default_width")


def texts(shown_codes: DataFrame, code_maps: DataFrame) -> DataFrame:
    """doc_id, page, seq, font_name, text of each string shown that has a code. Only the
    different codes of a page's font are rows and meet the ranges; what they stand for
    comes back as a map, in which a string's codes are looked up. Maps are searched from
    end to end, so a font's has one for each 256 codes inside."""
    shown = shown_codes.where(F.size("codes") > 0)
    own = shown.select(*FONT, F.explode(F.array_distinct("codes")).alias("code")).distinct()
    # written, as joining counts them first: else documents are read again each time
    own, code_maps = materialize(own, "codes"), materialize(code_maps, "maps")
    entries = characters(own, code_maps).groupBy(*FONT).agg(F.sort_array(F.collect_list(F.struct("code", "text"))).alias("known"))
    high = lambda c: F.shiftright(c, 8)
    make = lambda part: F.struct(high(F.get(part, 0)["code"]).alias("high"), F.map_from_entries(part).alias("of"))
    blocks = grouped(entries.withColumn("known", fixed(F.col("known"))), "known", lambda x, before: high(x["code"]) != high(before["code"]), make, "blocks")
    maps = blocks.select(*FONT, fixed(F.map_from_entries("blocks")).alias("map"))
    found = shown.join(maps.hint("merge"), FONT, "left")
    text = F.array_join(F.transform("codes", lambda c: F.try_element_at(F.try_element_at("map", high(c)), c)), "")
    return found.select("doc_id", "page", "seq", "font_name", text.alias("text"))


def texts_of_pages(page_codes: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """As texts(), from rows that hold what a page shows and its fonts' ranges. Documents are
    read once. Pages of up to `in_row` ranges have their different codes looked up in their
    row, without an exchange; the rest, if any, by joins."""
    pages = materialize(page_codes, "codes")
    out = _in_row(pages.where(F.size("maps") <= in_row))
    far = pages.where(F.size("maps") > in_row)
    if far.isEmpty():
        return out
    shown = far.select("doc_id", "page", F.explode("shown").alias("s")).select("doc_id", "page", "s.*")
    return out.unionAll(texts(shown, far.select("doc_id", "page", F.explode("maps").alias("m")).select("doc_id", "page", "m.*")))


def _in_row(pages: DataFrame) -> DataFrame:
    names = F.array_distinct(F.transform("shown", lambda s: s["font_name"]))
    own = lambda n: F.array_distinct(F.flatten(F.transform(F.filter("shown", lambda s: s["font_name"] == n), lambda s: F.array_distinct(s["codes"]))))
    fonts = F.transform(names, lambda n: F.struct(n.alias("font_name"), own(n).alias("codes"), F.filter("maps", lambda m: m["font_name"] == n).alias("maps")))
    pages = pages.withColumn("fonts", fixed(fonts)).drop("maps")
    best = lambda c, maps: F.array_min(F.transform(F.filter(maps, lambda m: (m["first_code"] <= c) & (c <= m["last_code"])), lambda m: F.struct(m["rank"], m["first_code"], m["last_code"], m["to"])))
    ranged = F.transform("fonts", lambda f: F.struct(f["font_name"].alias("font_name"), F.transform(f["codes"], lambda c: F.struct(c.alias("code"), best(c, f["maps"]).alias("m"))).alias("codes")))
    pages = pages.withColumn("fonts", fixed(ranged))
    high = lambda c: F.shiftright(c, 8)
    blocks = lambda known: F.map_from_entries(F.transform(F.array_distinct(F.transform(known, lambda k: high(k["code"]))), lambda h: F.struct(h, F.map_from_entries(F.transform(F.filter(known, lambda k: high(k["code"]) == h), lambda k: F.struct(k["code"], _character(k["code"], k["m"]["first_code"], k["m"]["to"])))))))
    pages = pages.withColumn("known", fixed(F.map_from_entries(F.transform("fonts", lambda f: F.struct(f["font_name"], blocks(f["codes"])))))).drop("fonts")
    rows = pages.select("doc_id", "page", "known", F.explode(F.filter("shown", lambda s: F.size(s["codes"]) > 0)).alias("s"))
    rows = rows.select("doc_id", "page", "s.seq", "s.font_name", F.col("s.codes").alias("codes"), fixed(F.try_element_at("known", F.col("s.font_name"))).alias("map"))
    text = F.array_join(F.transform("codes", lambda c: F.try_element_at(F.try_element_at("map", high(c)), c)), "")
    return rows.select("doc_id", "page", "seq", "font_name", text.alias("text"))


def page_widths(shown_codes: DataFrame, font_widths: DataFrame) -> DataFrame:
    """doc_id, page, width: of all codes that a page shows. Only different codes, counted,
    meet the ranges."""
    counted = shown_codes.select(*FONT, F.explode("codes").alias("code")).groupBy(*FONT, "code").agg(F.count("*").alias("n"))
    counted, font_widths = materialize(counted, "codes"), materialize(font_widths, "widths")
    return widths(counted, font_widths).groupBy("doc_id", "page").agg(F.sum(F.col("width") * F.col("n")).alias("width"))
