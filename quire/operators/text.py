"""Page text in its orders, from kernel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions.arrays import fixed

PAGE = ["doc_id", "page"]
FORM_FEED = "\f"


def join_pages(page_text: DataFrame, separator: str = FORM_FEED, text: str = "text") -> DataFrame:
    """doc_id, text: pages in order; a page without text leaves its separator."""
    pages = F.sort_array(F.collect_list(F.struct("page", F.coalesce(text, F.lit("")).alias("t"))))
    return page_text.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["t"]), separator).alias("text"))


def tagged(refs: Column, marked: Column) -> Column:
    """Marked content in the order of the structure tree; a mark without text is passed
    over."""
    return F.array_join(F.filter(F.transform(refs, lambda r: F.element_at(marked, r["mcid"])), lambda t: t.isNotNull() & (t != "")), " ")


def enough(tagged_text: Column, plain: Column) -> Column:
    """Whether tagged text counts: it has 60 % of the bytes of the stream-order text."""
    return (tagged_text != "") & (F.octet_length(tagged_text) >= F.floor(F.octet_length(plain) * 6 / 10))


def document_text(document_pages: DataFrame, order: str = "structured", separator: str = FORM_FEED) -> DataFrame:
    """doc_id, text: a document's pages in order, a separator between; nothing is exchanged.
    structured or plain, page by page. A page whose stream order is empty shows nothing,
    so geometric order has nothing for it either."""
    # two steps, so that the tagged text of a page is made once
    made = F.transform("pages", lambda p: F.struct(p["plain"].alias("plain"), tagged(p["refs"], p["marked"]).alias("tagged")))
    both = document_pages.select("doc_id", fixed(made).alias("made")) if order == "structured" else None
    texts = F.transform("pages", lambda p: p["plain"]) if both is None else F.transform("made", lambda p: F.when(enough(p["tagged"], p["plain"]), p["tagged"]).otherwise(p["plain"]))
    return (document_pages if both is None else both).select("doc_id", F.array_join(texts, separator).alias("text"))


def from_operators(content_ops: DataFrame, forms: bool = True) -> DataFrame:
    """doc_id, page, text in stream order from content operators, by windows over
    each content stream: the state before an operator is the last value set."""
    ops = content_ops if forms else content_ops.where("depth = 0")
    frame = Window.partitionBy(*PAGE, "frame").orderBy("seq")
    upto, before = frame.rowsBetween(Window.unboundedPreceding, 0), frame.rowsBetween(Window.unboundedPreceding, -1)
    shows, moves = F.col("parts").isNotNull(), F.col("op").isin("Td", "TD", "Tm")
    last = lambda c, w, default: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(default))
    s = ops.withColumn("now", last(F.when(F.col("op") == "Tf", F.col("size")), upto, 12.0))
    s = s.withColumn("ref", F.greatest("now", last(F.when(shows, F.col("now")), before, 12.0)))
    s = s.withColumn("py", last(F.when(moves, F.col("y")), before, 0.0)).withColumn("px", last(F.when(F.col("op") == "Tm", F.col("x")), before, 0.0))
    vertical = F.col("wmode") == 1
    go, was = F.when(vertical, F.col("x")).otherwise(F.col("y")), F.when(vertical, F.col("px")).otherwise(F.col("py"))
    breaks = (
        F.when(F.col("op").isin("T*", "'", '"'), True)
        .when(F.col("op").isin("Td", "TD"), (F.abs(go) > F.col("ref") * 0.7) & (F.col("py") != 0))
        .when(F.col("op") == "Tm", (F.abs(go - was) > F.col("ref") * 0.7) & (was != 0))
        .otherwise(False)
    )
    shown = F.array_join(F.transform("parts", lambda p: F.when(p["text"].isNotNull(), p["text"]).when(p["adjust"] < -100, F.lit(" ")).otherwise(F.lit(""))), "")
    s = s.withColumn("piece", F.concat(F.when(breaks, F.lit("\n")).otherwise(F.lit("")), F.coalesce(shown, F.lit(""))))
    pieces = F.sort_array(F.collect_list(F.struct("seq", "piece")))
    return s.groupBy(*PAGE).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))


def structured(page_all: DataFrame) -> DataFrame:
    """doc_id, page, text, source. Marked content in the order of the structure tree
    if that has 60 % of the bytes of the stream-order text; else stream order, or if
    that is empty, geometric order. A mark without text is passed over."""
    p = page_all.withColumn("tagged", fixed(tagged(F.col("refs"), F.col("marked"))))
    p = p.withColumn("source", fixed(F.when(enough(F.col("tagged"), F.col("plain")), "structure").when(F.col("plain") != "", "stream").otherwise("geometric")))
    # pages that need no third order fold no spans
    p = p.withColumn("spans", fixed(F.when(F.col("source") == "geometric", F.col("spans")).otherwise(F.slice("spans", 1, 0))))
    text = F.when(F.col("source") == "structure", F.col("tagged")).when(F.col("source") == "stream", F.col("plain")).otherwise(F.col("rows"))
    return L.geometric_text(p, out="rows").select(*PAGE, text.alias("text"), "source")


def structured_by_join(mcid_refs: DataFrame, mcid_text: DataFrame) -> DataFrame:
    """doc_id, page, text of marked content in tree order, as a join of the marks
    with their text."""
    both = mcid_refs.join(mcid_text, ["doc_id", "page", "mcid"]).where("text <> ''")
    parts = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return both.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("text"))
