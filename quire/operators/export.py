"""Documents as JSON, text or Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import fixed
from quire.functions.text import page_label
from quire.sources.pdf import extract

METADATA = ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date")


def json_documents(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """doc_id, json: metadata, page count, outline (page -1 without a target) and
    pages from 1 with label, text, links and images (targets count from 0). Fields
    that are null are left out. One kernel pass gives a row for each document, and
    nothing is exchanged."""
    whole = extract(files, "whole", mode=mode).withColumn("ranges", fixed(F.sort_array("label_ranges")))
    rounded = lambda rect: F.transform(rect, lambda v: F.round(v, 1)).alias("rect")

    def page(p):
        r = F.try_element_at(F.filter("ranges", lambda r: r["start"] <= p["page"]), F.lit(-1))
        label = F.when(r.isNotNull(), page_label(p["page"], r["start"], r["style"], r["prefix"], r["first"]))
        links = F.transform(p["links"], lambda x: F.struct(x["uri"].alias("uri"), x["dest_page"].alias("dest_page"), rounded(x["rect"])))
        images = F.transform(p["images"], lambda x: F.struct(rounded(x["rect"]), x["width"].alias("width"), x["height"].alias("height")))
        return F.struct((p["page"] + 1).alias("page"), label.alias("label"), p["text"].alias("text"), links.alias("links"), images.alias("images"))

    item = lambda o: F.struct(o["title"].alias("title"), F.coalesce(o["dest_page"], F.lit(-1)).alias("page"), o["level"].alias("level"))
    body = F.struct(
        F.struct(*METADATA).alias("metadata"), F.col("n_pages").alias("page_count"),
        F.transform("outline", item).alias("outline"), F.transform("pages", page).alias("pages"),
    )
    return whole.select("doc_id", fixed(F.to_json(body)).alias("json"))


def write_text(texts: DataFrame, path: str, column: str = "text") -> None:
    """One text column as files, rows apart by a line of their own."""
    texts.select(column).write.text(path, lineSep="\n")


def error_report(parse_errors: DataFrame, shown: int = 10) -> DataFrame:
    """doc_id, n_errors and the first `shown` messages."""
    first = F.slice(F.sort_array(F.collect_list(F.struct("offset", "kind", "message", "page"))), 1, shown)
    return parse_errors.groupBy("doc_id").agg(F.count("*").alias("n_errors"), first.alias("first"))
