"""Markdown from spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import fixed, grouped, shifted
from quire.functions.layout import GEOMETRIC, by_rows, whole
from quire.functions.text import indent_level, is_bullet, is_numbered, strip_bullet, strip_number

PAGE = ["doc_id", "page"]
PAGE_BREAK = "\n---\n\n"


@dataclass(frozen=True)
class MarkdownOptions:
    detect_headings: bool = True
    h1_ratio: float = 1.8
    h2_ratio: float = 1.5
    h3_ratio: float = 1.3
    detect_lists: bool = True
    page_breaks_as_hr: bool = True


def _body(spans: str):
    """The font size (to a tenth) with the most bytes of text; of equal ones the
    smallest; 12 where no span has text."""
    sized = F.sort_array(F.transform(F.col(spans), lambda s: F.struct(whole(s["font_size"] * 10).alias("k"), F.octet_length(s["text"]).cast("long").alias("n"))))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("k"), zero.alias("n"), F.lit(120).cast("long").alias("best"), zero.alias("most"))

    def step(a, s):
        n = F.when(s["k"] == a["k"], a["n"]).otherwise(0) + s["n"]
        more = n > a["most"]
        return F.struct(s["k"].alias("k"), n.alias("n"), F.when(more, s["k"]).otherwise(a["best"]).alias("best"), F.when(more, n).otherwise(a["most"]).alias("most"))

    return F.aggregate(sized, start, step, lambda a: a["best"]) / 10


def body_size(page_spans: DataFrame) -> DataFrame:
    """doc_id, page, body_size, min_size, max_size of pages with spans."""
    sizes = F.transform("spans", lambda s: s["font_size"])
    return page_spans.where(F.size("spans") > 0).select(*PAGE, fixed(_body("spans")).alias("body_size"), F.array_min(sizes).alias("min_size"), F.array_max(sizes).alias("max_size"))


def _elements(page_spans: DataFrame, options: MarkdownOptions) -> DataFrame:
    """Pages with an array `elements` of kind, indent_level, text, folded in their row.
    Spans by rows, those without text left out; a line starts where y moves over 3
    points from the span before; its first span decides what it is. A move over 1.2
    body sizes puts a line_break before it."""
    shown = page_spans.select(*PAGE, fixed(F.filter("spans", lambda s: s["text"] != "")).alias("shown"))
    pages = shown.select(*PAGE, fixed(_body("shown")).alias("body"), fixed(by_rows("shown", GEOMETRIC)).alias("spans"))
    item = lambda s, p: F.struct(F.coalesce(F.abs(s["y0"] - p["y0"]), F.lit(0.0)).alias("move"), (s["x0"] - p["x1"] > p["font_size"] * 0.15).alias("gap"), *(s[c].alias(c) for c in ("x0", "font_size", "text")))
    pages = pages.select(*PAGE, "body", fixed(F.zip_with("spans", shifted("spans"), item)).alias("items"))
    text = lambda part: F.array_join(F.transform(part, lambda s, i: F.concat(F.when((i > 0) & s["gap"], F.lit(" ")).otherwise(F.lit("")), s["text"])), "")
    make = lambda part: F.struct(*(F.get(part, 0)[c].alias(c) for c in ("move", "x0", "font_size")), F.get(part, 0)["text"].alias("head"), text(part).alias("text"))
    pages = grouped(pages, "items", lambda x, _: x["move"] > GEOMETRIC, make, "lines")

    def of(line, i):
        ratio, kind = line["font_size"] / F.col("body"), F.when(F.lit(False), "")
        if options.detect_headings:
            kind = kind.when(ratio >= options.h1_ratio, "heading1").when(ratio >= options.h2_ratio, "heading2").when(ratio >= options.h3_ratio, "heading3")
        if options.detect_lists:
            kind = kind.when(is_bullet(line["head"]), "list_item_bullet").when(is_numbered(line["head"]), "list_item_number")
        own = F.struct(kind.otherwise("paragraph").alias("kind"), indent_level(line["x0"]).alias("indent_level"), line["text"].alias("text"))
        blank = F.struct(F.lit("line_break").alias("kind"), F.lit(0).alias("indent_level"), F.lit("").alias("text"))
        return F.when((i > 0) & (line["move"] > F.col("body") * 1.2), F.array(blank, own)).otherwise(F.array(own))

    return pages.select(*PAGE, fixed(F.flatten(F.transform("lines", of))).alias("elements"))


def elements(page_spans: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """doc_id, page, elem_no, kind, indent_level, text."""
    return _elements(page_spans, options).select(*PAGE, F.posexplode_outer("elements").alias("elem_no", "e")).where("e is not null").select(*PAGE, "elem_no", "e.*")


def _rendered(pages: DataFrame) -> DataFrame:
    """Pages with their array `elements` as Markdown, blank lines between those of
    different kinds."""
    items = ("list_item_bullet", "list_item_number")

    def piece(e, before):
        kind, text, was = e["kind"], e["text"], before["kind"]
        blank = (
            F.when(kind.startswith("heading") | (kind == "code_block"), True)
            .when(kind == "paragraph", ~was.isin("paragraph", "line_break"))
            .when(kind.isin(*items), ~was.isin(*items))
            .otherwise(False)
        )
        indent = F.repeat(F.lit("  "), e["indent_level"])
        body = (
            F.when(kind.startswith("heading"), F.concat(F.repeat(F.lit("#"), F.substr(kind, F.lit(8)).cast("int")), F.lit(" "), text))
            .when(kind == "list_item_bullet", F.concat(indent, F.lit("- "), strip_bullet(text)))
            .when(kind == "list_item_number", F.concat(indent, F.lit("1. "), strip_number(text)))
            .when(kind == "table_row", F.concat(F.lit("| "), text, F.lit(" |")))
            .when(kind == "code_block", F.concat(F.lit("```\n"), text, F.lit("\n```")))
            .when(kind == "blockquote", F.concat(F.lit("> "), text))
            .when(kind == "horizontal_rule", F.lit("\n---\n"))
            .otherwise(text)
        )
        return F.concat(F.when(was.isNotNull() & blank, F.lit("\n")).otherwise(F.lit("")), body, F.lit("\n"))

    return pages.select(*PAGE, fixed(F.array_join(F.zip_with("elements", shifted("elements"), piece), "")).alias("text"))


def pages(page_spans: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """doc_id, page, text: every page as Markdown, without an exchange; a page without
    text gives the empty one."""
    return _rendered(_elements(page_spans, options))


def render(elements: DataFrame) -> DataFrame:
    """doc_id, page, text of elements that are rows of a table."""
    one = F.struct("elem_no", "kind", "indent_level", "text")
    return _rendered(elements.groupBy(*PAGE).agg(F.sort_array(F.collect_list(one)).alias("elements")))
