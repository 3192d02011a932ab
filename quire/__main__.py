"""python -m quire extract|info|search|bench ...: the library on the command line."""

from __future__ import annotations

import argparse
import sys
import time
from statistics import mean, pstdev

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.api import read_pdf
from quire.functions.text import page_numbers
from quire.operators.export import METADATA, error_report
from quire.operators.markdown import PAGE_BREAK
from quire.operators.text import FORM_FEED, join_pages


def described(r, pages: int = 10, items: int = 50) -> list[str]:
    """A row of `info` as lines: the first page sizes and outline items."""
    out = [f"File: {r['doc_id']}", f"Size: {r['size']} bytes", f"Pages: {r['n_pages']}", f"XRef entries: {r['n_xref']}", f"Encrypted: {'yes' if r['is_encrypted'] else 'no'}"]
    names = {"creation_date": "Created", "mod_date": "Modified"}
    meta = [f"  {names.get(k, k.title())}: {r[k]}" for k in METADATA if r[k] is not None]
    out += ["Metadata:", *meta] if meta else []
    out += ["Page sizes:", *(f"  Page {k + 1}: {p['width']:.0f} x {p['height']:.0f} pts" + f" (rotated {p['rotation']} degrees)" * bool(p["rotation"]) for k, p in enumerate(r["page_sizes"][:pages]))]
    out += [f"  ... and {len(r['page_sizes']) - pages} more pages"] if len(r["page_sizes"]) > pages else []
    if r["outline"]:
        out += ["Outline:", *("  " * (o["level"] + 1) + o["title"] + (f" (page {o['dest_page'] + 1})" if o["dest_page"] is not None else "") for o in r["outline"][:items])]
        out += [f"  ... and {len(r['outline']) - items} more entries"] if len(r["outline"]) > items else []
    return out + ([f"Form fields: {r['n_fields']}"] if r["n_fields"] else [])


def timed(corpus, runs: int) -> list[str]:
    """Mean, least, most and population deviation of `runs` times of each order."""
    corpus.files = corpus.files.cache()
    n = corpus.pages().count()
    out = [f"{n} pages, {runs} runs"]
    for name, read in (("sequential", lambda: corpus.text("plain")), ("structured", lambda: corpus.text("structured")), ("visual", lambda: corpus.text("visual")), ("markdown", corpus.markdown)):
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            read().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out.append(f"{name}: mean {mean(took):.3f} s, min {min(took):.3f}, max {max(took):.3f}, stddev {pstdev(took):.3f}, {n / mean(took):.0f} pages/s")
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract")
    e.add_argument("path")
    e.add_argument("-o", "--output")
    e.add_argument("-p", "--pages", help="pages from 1, such as 1-3,7")
    e.add_argument("-f", "--format", choices=["text", "txt", "json", "markdown", "md"], default="text")
    e.add_argument("-m", "--markdown", action="store_true")
    e.add_argument("--json", action="store_true")
    e.add_argument("--sequential", action="store_true", help="stream order")
    e.add_argument("--reading-order", action="store_true", help="visual order")
    e.add_argument("--strict", action="store_true")
    e.add_argument("--permissive", action="store_true")
    i = commands.add_parser("info")
    i.add_argument("path")
    b = commands.add_parser("bench", help="times of reading all text, in each order")
    b.add_argument("path")
    b.add_argument("--runs", type=int, default=5)
    s = commands.add_parser("search")
    s.add_argument("query")
    s.add_argument("path")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    corpus = read_pdf(spark, a.path, "FAILFAST" if getattr(a, "strict", False) else "PERMISSIVE")
    if a.command == "info":
        for r in corpus.info().orderBy("doc_id").toLocalIterator():
            print("\n".join(described(r)))
    elif a.command == "bench":
        for line in timed(corpus, a.runs):
            print(line)
    elif a.command == "search":
        for r in corpus.search(a.query).orderBy("doc_id", "page", "offset").toLocalIterator():
            print(f"{r['doc_id']}: page {r['page'] + 1}, offset {r['offset']}: {r['context']}")
    else:
        form = "json" if a.json else "markdown" if a.markdown or a.format in ("markdown", "md") else a.format
        if form == "json":
            out = corpus.json().select("doc_id", F.col("json").alias("text"))
        else:
            pages = corpus.markdown() if form == "markdown" else corpus.text("visual" if a.reading_order else "plain" if a.sequential else "structured")
            if a.pages:
                wanted = corpus.page_count().select("doc_id", F.posexplode(page_numbers(F.lit(a.pages), F.col("n_pages"))).alias("at", "page"))
                pages = wanted.join(pages, ["doc_id", "page"]).select("doc_id", F.col("at").alias("page"), "text")
            out = join_pages(pages, PAGE_BREAK if form == "markdown" else FORM_FEED)
        if a.output:
            out.select("text").write.text(a.output)
        else:
            for r in out.orderBy("doc_id").toLocalIterator():
                print(r["text"])
        for r in error_report(corpus.parse_errors()).toLocalIterator():
            print(f"{r['doc_id']}: {r['n_errors']} errors: {[x['message'] for x in r['first']]}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
