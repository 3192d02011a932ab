"""Search, labels and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import fixed, running_sums
from quire.functions.text import ascii_lower, page_label
from quire.sources.pdf import extract

CONTEXT = 50


def search(page_text: DataFrame, query: str, context: int = CONTEXT) -> DataFrame:
    """doc_id, page, offset, context: hits of query in order, letters A-Z matched in
    either case, without overlap. Offsets count bytes; the context is the bytes
    around, as valid UTF-8. An empty query has no hits. All in built-in functions:
    the text is split at the query, and a hit ends each piece but the last."""
    if not query:
        return page_text.select("doc_id", "page", F.lit(0).cast("long").alias("offset"), F.lit("").alias("context")).limit(0)
    q = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    size = len(query.encode())
    low = page_text.where(F.contains(ascii_lower("text"), F.lit(q))).select("doc_id", "page", "text", F.split(ascii_lower("text"), _quoted(q), -1).alias("pieces"))
    lengths = F.transform(F.slice("pieces", F.lit(1), F.size("pieces") - 1), lambda p: F.octet_length(p).cast("long") + size)
    ends = running_sums(low.withColumn("lengths", fixed(lengths)), "lengths", "ends")
    hits = ends.select("doc_id", "page", "text", F.explode_outer("ends").alias("end")).where("end is not null").select("doc_id", "page", "text", (F.col("end") - size).alias("offset"))
    return in_context(hits, size, context)


def in_context(hits: DataFrame, size: int, context: int) -> DataFrame:
    """doc_id, page, offset, and the bytes of the text around, as valid UTF-8."""
    raw = F.col("text").cast("binary")
    start = F.greatest(F.col("offset") - context, F.lit(0))
    end = F.least(F.col("offset") + size + context, F.octet_length("text"))
    cut = F.substr(raw, (start + 1).cast("int"), (end - start).cast("int"))
    return hits.select("doc_id", "page", "offset", F.make_valid_utf8(cut.cast("string")).alias("context"))


def _quoted(text: str) -> str:
    import re

    return re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", text)


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, page, label: an as-of join, the range with the greatest start up to
    the page. A document's ranges are gathered (they are few) and searched in each
    page's row, so pages are not multiplied. Pages before all ranges have none."""
    held = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "style", "prefix", "first"))).alias("ranges"))
    own = pages.select("doc_id", "page").join(held, "doc_id").withColumn("r", F.try_element_at(F.filter("ranges", lambda r: r["start"] <= F.col("page")), F.lit(-1)))
    return own.where(F.col("r").isNotNull()).select("doc_id", "page", page_label("page", "r.start", "r.style", "r.prefix", "r.first").alias("label"))


def link_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the object number of the page that they go to."""
    return links.join(pages.select("doc_id", F.col("page").alias("dest_page"), F.col("obj_num").alias("dest_obj")), ["doc_id", "dest_page"], "left")


def info(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each document: size, pages, objects, flags, metadata, sizes of pages
    and outline, from one kernel pass."""
    return extract(files, "info", mode=mode)
