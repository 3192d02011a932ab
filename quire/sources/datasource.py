"""`spark.read.format("pdf")`, table functions and a scalar function for SQL."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import IntegerType

from quire.kernel.content import PageReader, spans, stream_text
from quire.kernel.document import FAILURES, Document
from quire.schemas import TABLES
from quire.sources.pdf import KERNELS, InvalidPdfError


FILES = "doc_id string, modificationTime timestamp, length long, content binary"


def page_set(spec: str) -> frozenset[int]:
    """Pages from 0 of a range such as 1-3,7; a part that says no page is passed over."""
    out: set[int] = set()
    for a, dash, b in (part.partition("-") for part in spec.split(",")):
        if a.strip().isdecimal() and (not dash or b.strip().isdecimal()):
            out.update(range(max(0, int(a) - 1), int(b) if dash else int(a)))
    return frozenset(out)


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(path: str) -> list[tuple[str, int, int]]:
    """Path, modification time (nanoseconds) and size of the PDFs under a path, by path: one
    listing of the file system that the path names (local, or any that pyarrow opens)."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.mtime_ns or 0, f.size) for f in found if f.type == FileType.File and (f.path == root or f.path.lower().endswith(".pdf")))


def opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def packed(found: list[tuple[str, int, int]], per_task: int) -> list[Part]:
    """Files in order of their paths, about so many bytes together to a task."""
    parts, held = [], 0
    for path, _, n in found:
        if not parts or held + n > per_task:
            parts.append(Part([]))
            held = 0
        parts[-1].paths.append(path)
        held += n
    return parts


class _Files:
    """Options: path, table, pages (from 1, such as 1-3,7), mode, bytesPerTask. The table
    `files` has the files themselves."""

    def __init__(self, options: dict):
        self.table = options.get("table", "page_text")
        self.path, self.per_task = options["path"], int(options.get("bytesPerTask", 64 << 20))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.pages = page_set(options["pages"]) if options.get("pages") else None

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path in partition.paths:
            try:
                with fs.open_input_file(path) as f:
                    data = f.read()
                if self.table == "files":
                    info = fs.get_file_info(path)
                    rows = [(path, info.mtime, info.size, data)]
                else:
                    rows = [(path, *row) for row in KERNELS[self.table](Document(data, self.strict), self.pages)]
            except (*FAILURES, OSError) as e:
                if self.strict:
                    raise InvalidPdfError(f"{path}: {e}") from e
                rows = [(path, "kernel", 0, f"{type(e).__name__}: {e}", None)] if self.table == "parse_errors" else []
            yield from rows


class PdfReader(_Files, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.names: list[Callable[[str], bool]] = []

    def partitions(self) -> list[Part]:
        return packed([f for f in listed(self.path) if all(test(f[0]) for test in self.names)], self.per_task)


class FilteredReader(PdfReader):
    """Filters on doc_id choose the files that are opened; filters on page, in tables of
    pages, the pages that are interpreted. Others are left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            test = _test(f)
            if test is None or f.attribute not in (("doc_id",), ("page",)) or (f.attribute == ("page",) and self.table not in PAGED):
                yield f
            elif f.attribute == ("doc_id",):
                self.names.append(test)
            else:
                self.pages = Pages(self.pages, test)


class Pages:
    """The page numbers of a set (None: all) that pass a test."""

    def __init__(self, own: frozenset | Pages | None, test: Callable[[int], bool]):
        self.own, self.test = own, test

    def __contains__(self, page: int) -> bool:
        return (self.own is None or page in self.own) and self.test(page)


class Compares:
    """A comparison with a value, as a test that can be sent to executors."""

    def __init__(self, how: str, value):
        self.how, self.value = how, value

    def __call__(self, x) -> bool:
        v = self.value
        return {"eq": x == v, "in": self.how == "in" and x in v}[self.how] if self.how in ("eq", "in") else {"lt": x < v, "le": x <= v, "gt": x > v, "ge": x >= v}[self.how]


def _test(f: Filter) -> Compares | None:
    for kind, how in ((EqualTo, "eq"), (In, "in"), (LessThan, "lt"), (LessThanOrEqual, "le"), (GreaterThan, "gt"), (GreaterThanOrEqual, "ge")):
        if isinstance(f, kind) and f.value is not None:
            return Compares(how, f.value)
    return None


#: Tables that have a row or more for a page and read nothing of others.
PAGED = ("page_text", "page_spans", "page_ops", "page_paints", "page_all", "content_ops", "mcid_text", "links", "pages", "fonts", "font_widths", "code_maps", "shown_codes")
#: Files changed within so many nanoseconds wait for the next batch of a stream.
SETTLE = 1_000_000_000


class PdfStream(_Files, DataSourceStreamReader):
    """Files by the time of their last change: a batch has those changed since the one
    before, so that a changed file comes again. Files put there with an old time are not
    seen."""

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        now = time.time_ns() - SETTLE
        return {"until": max((t for _, t, _ in listed(self.path) if t <= now), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return packed([f for f in listed(self.path) if start["until"] < f[1] <= end["until"]], self.per_task)


class PdfSource(DataSource):
    """A table of PDFs under a path that the Python processes can open. For one that only
    Spark can use quire.sources.pdf.files, which reads through Spark's own formats."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        table = self.options.get("table", "page_text")
        return FILES if table == "files" else TABLES[table]

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)

    def streamReader(self, schema) -> PdfStream:
        return PdfStream(self.options)


class FilteredSource(PdfSource):
    """The same for pdf_table, which says why it stands apart."""

    @classmethod
    def name(cls) -> str:
        return "pdf_filtered"

    def reader(self, schema) -> FilteredReader:
        return FilteredReader(self.options)


@F.udtf(returnType="page: int, text: string")
class PdfPages:
    def eval(self, content: bytes):
        doc = Document(content or b"")
        reader = PageReader(doc)
        for p in doc.pages:
            yield p.number, stream_text(reader.ops(p))


@F.udtf(returnType="page: int, x0: double, y0: double, x1: double, y1: double, text: string, font_size: double")
class PdfSpans:
    def eval(self, content: bytes):
        doc = Document(content or b"")
        reader = PageReader(doc)
        for p in doc.pages:
            for s in spans(reader.ops(p, forms=False)):
                yield p.number, *s


@F.udtf(returnType="offset: bigint, context: string")
class PdfSearch:
    def eval(self, text: str, query: str):
        raw, q = (text or "").encode(), (query or "").encode()
        low, q, at = raw.lower(), q.lower(), 0
        while q and (at := low.find(q, at)) >= 0:
            yield at, raw[max(0, at - 50) : at + len(q) + 50].decode("utf-8", "replace")
            at += len(q)


@F.udf(IntegerType())
def pdf_page_count(content: bytes) -> int:
    return len(Document(content or b"").pages)


def pdf_table(spark: SparkSession, path: str, table: str = "page_text", mode: str = "PERMISSIVE") -> DataFrame:
    """A table of the PDFs under a path, into which Spark pushes filters on doc_id and page.

    Pushing is on in a session of the table's own: in Spark 4.1 a table of a Python source
    that is read with a filter and then without one gives the filter's rows again. Here
    each reading has a filter, that doc_id is not null, so each is planned anew."""
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.dataSource.register(FilteredSource)
    return own.read.format("pdf_filtered").option("table", table).option("mode", mode).load(path).where(F.col("doc_id").isNotNull())


def register(spark: SparkSession) -> None:
    """The pdf format, pdf_pages(content), pdf_spans(content), pdf_search(text, q)
    and pdf_page_count(content)."""
    spark.dataSource.register(PdfSource)
    for name, f in (("pdf_pages", PdfPages), ("pdf_spans", PdfSpans), ("pdf_search", PdfSearch)):
        spark.udtf.register(name, f)
    spark.udf.register("pdf_page_count", pdf_page_count)
