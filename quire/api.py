"""The facade: a corpus of PDFs, one DataFrame for each feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import export, layout, search
from quire.operators import markdown as M
from quire.operators import text as X
from quire.sources import pdf
from quire.sources.pdf import ExtractionError, InvalidPdfError, PageNotFoundError, extract
from quire.sources.sink import write_documents


class PdfCorpus:
    """Files (doc_id, content) and what can be read from them. Everything is lazy;
    each table runs the kernel for that table alone. Pages count from 0."""

    def __init__(self, files: DataFrame, mode: str = "PERMISSIVE", pages: Sequence[int] | None = None, rebuild: bool = False):
        self.files, self.mode, self.only, self.rebuild = files, mode, pages, rebuild

    def table(self, name: str) -> DataFrame:
        return extract(self.files, name, pages=self.only, mode=self.mode, rebuild=self.rebuild)

    def page_count(self) -> DataFrame:
        return self.table("document").select("doc_id", "n_pages")

    def is_encrypted(self) -> DataFrame:
        return self.table("document").select("doc_id", "is_encrypted")

    def info(self) -> DataFrame:
        return self.table("info")

    def pages(self) -> DataFrame:
        return self.table("pages")

    def text(self, order: str = "stream") -> DataFrame:
        """doc_id, page, text. stream: with forms; plain: without; structured: marked
        content first; geometric; visual (columns)."""
        if order in ("stream", "plain"):
            return self.table("page_text").select("doc_id", "page", F.col(order).alias("text"))
        if order == "structured":
            return X.structured(self.table("page_all")).select("doc_id", "page", "text")
        if order == "geometric":
            return layout.geometric(self.table("page_spans"))
        if order == "visual":
            return layout.visual(self.table("page_spans")).select("doc_id", "page", "text")
        raise ValueError(f"no such order: {order}")

    def full_text(self, mode: str = "accuracy") -> DataFrame:
        """doc_id, text: all pages, a form feed between. accuracy or fast."""
        return X.document_text(self.table("document_pages"), {"accuracy": "structured", "fast": "plain"}[mode])

    def spans(self) -> DataFrame:
        """Flat spans, with width and height."""
        return layout.with_sizes(layout.span_rows(self.table("page_spans")))

    def words(self) -> DataFrame:
        return layout.words(self.table("page_spans"))

    def lines(self) -> DataFrame:
        return layout.lines(self.table("page_spans"))

    def paragraphs(self) -> DataFrame:
        return layout.paragraphs(self.table("page_spans"))

    def markdown_elements(self, options: M.MarkdownOptions = M.MarkdownOptions()) -> DataFrame:
        return M.elements(self.table("page_spans"), options)

    def markdown(self, options: M.MarkdownOptions = M.MarkdownOptions()) -> DataFrame:
        return M.pages(self.table("page_spans"), options)

    def full_markdown(self, options: M.MarkdownOptions = M.MarkdownOptions()) -> DataFrame:
        return X.join_pages(self.markdown(options), M.PAGE_BREAK if options.page_breaks_as_hr else "\n")

    def metadata(self) -> DataFrame:
        return self.table("metadata")

    def outline(self) -> DataFrame:
        return self.table("outline")

    def page_labels(self) -> DataFrame:
        return search.page_labels(self.table("pages"), self.table("label_ranges"))

    def links(self) -> DataFrame:
        return self.table("links")

    def images(self) -> DataFrame:
        return self.table("images")

    def form_fields(self) -> DataFrame:
        return self.table("form_fields")

    def fonts(self) -> DataFrame:
        return self.table("fonts")

    def font_widths(self) -> DataFrame:
        """Widths of codes or CIDs, by ranges, and the glyph index of the first."""
        return self.table("font_widths")

    def parse_errors(self) -> DataFrame:
        return self.table("parse_errors")

    def search(self, query: str) -> DataFrame:
        return search.search(self.text("structured"), query)

    def json(self) -> DataFrame:
        return export.json_documents(self.files, self.mode)

    def write(self, path: str, form: str = "text", overwrite: bool = False) -> None:
        """One file for each document under a path: text, markdown or json."""
        made = {"text": (self.full_text, "text", "txt"), "markdown": (self.full_markdown, "text", "md"), "json": (self.json, "json", "json")}
        read, column, extension = made[form]
        write_documents(read(), path, column, extension, overwrite)

    # One document, on the driver

    def extract_page(self, doc_id: str, page: int, order: str = "stream") -> str:
        """The text of one page of one document."""
        one = PdfCorpus(self.files.where(F.col("doc_id") == doc_id), self.mode, [page])
        try:
            row = one.text(order).where(F.col("page") == page).first()
        except Exception as e:
            raise ExtractionError(str(e)) from e
        if row is None:
            raise PageNotFoundError(f"{doc_id} has no page {page}")
        return row["text"]


def read_pdf(spark: SparkSession, path: str, mode: str = "PERMISSIVE", pages: Sequence[int] | None = None, glob: str = "*.pdf") -> PdfCorpus:
    return PdfCorpus(pdf.files(spark, path, glob), mode, pages)


def from_binary(df: DataFrame, content: str = "content", doc_id: str = "doc_id", mode: str = "PERMISSIVE") -> PdfCorpus:
    """Documents in a BINARY column of any table."""
    return PdfCorpus(df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content")), mode)


__all__ = ["ExtractionError", "InvalidPdfError", "PageNotFoundError", "PdfCorpus", "from_binary", "read_pdf"]
