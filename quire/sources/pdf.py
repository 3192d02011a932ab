"""PDF bytes to tables: one Arrow-batched kernel pass, one row per thing found."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quire.kernel.content import SHOWN, PageReader, marked_text, operations, pieces, property_mcid, shown, spans, stream_text
from quire.kernel.document import FAILURES, Document, raw_text
from quire.kernel.objects import Name, Ref, Stream, int32
from quire.schemas import TABLES


class InvalidPdfError(ValueError):
    pass


class PageNotFoundError(IndexError):
    pass


class ExtractionError(RuntimeError):
    pass


def _pages(d: Document, only: frozenset | None):
    return d.pages if only is None else [p for p in d.pages if p.number in only]


def _document(d, only):
    yield (len(d.pages), len(d.xref), d.encrypted, d.has_structure, len(_form_fields(d)))


def _xref(d, only):
    for num, e in sorted(d.xref.items()):
        yield num, e.kind, e.offset, e.gen_or_index


def _xref_sections(d, only):
    for k, (at, (before, entries)) in enumerate(d.sections.items()):
        yield at, before, k == 0, [{"obj_num": n, "entry_type": e.kind, "offset": e.offset, "gen_or_index": e.gen_or_index} for n, e in entries]


def _document_sections(d, only):
    """All sections of a document in one row."""
    yield ([dict(zip(("start", "prev", "newest", "entries"), row)) for row in _xref_sections(d, only)],)


def _page_rows(d, only):
    for p in _pages(d, only):
        m = p.media_box
        yield p.number, p.ref.num if p.ref else None, m, p.crop_box, m[2] - m[0], m[3] - m[1], p.rotation


def _of_pages(d, only, rows, blank=None):
    """Rows of each page. A page that fails gives what `blank` makes of it, or nothing,
    and an error of the document; the other pages are not touched."""
    for p in _pages(d, only):
        yield from d.attempt(lambda: list(rows(p)), blank(p) if blank else (), p.number)


def _fonts(d, only):
    r = PageReader(d)

    def rows(p):
        for name, f in r.fonts(p).items():
            yield p.number, name, f.subtype, f.is_cid, f.bytes_per_char, f.wmode, f.ascender, f.descender, f.cap_height, f.x_height, f.italic_angle, f.missing_width

    return _of_pages(d, only, rows)


def _font_widths(d, only):
    r = PageReader(d)

    def rows(p):
        for name, f in r.fonts(p).items():
            for rank, (first, last, width) in enumerate(f.width_ranges()):
                yield p.number, name, first, last, width, f.default_width if f.is_cid else f.missing_width, f.ordering, f.gid(first) if f.is_cid else None, rank

    return _of_pages(d, only, rows)


def _ops(d, only):
    r = PageReader(d)

    def rows(p):
        for o in r.ops(p):
            parts = None if o.parts is None else [{"adjust": a, "text": t} for a, t in o.parts]
            yield p.number, o.seq, o.frame, o.depth, o.op, o.x, o.y, o.size, parts, o.mcid, o.wmode

    return _of_pages(d, only, rows)


def _maps_of_page(r, p):
    for name, f in r.fonts(p).items():
        ones = [(c, c, t, 0) for c, t in f.multi.items()] + [(c, c, chr(u), 1) for c, u in f.single.items() if c not in f.multi and 0 < u < 0xD800]
        spans = [(a, b, chr(to), 2 + len(f.ranges) - k) for k, (a, b, to) in enumerate(f.ranges) if to + b - a < 0xD800]
        for a, b, to, rank in ones + spans:
            yield p.number, name, a, b, to, rank


def _code_maps(d, only):
    """What fonts map codes to, as ranges; of several that hold a code that of least rank
    counts, of ranges with an offset the one that starts last."""
    r = PageReader(d)
    return _of_pages(d, only, lambda p: _maps_of_page(r, p))


def _codes_of_page(r, p):
    font = name = None
    fonts = r.fonts(p)
    for seq, (op, operands) in enumerate(operations(r.doc.contents(p))):
        if op == b"Tf" and len(operands) >= 2 and isinstance(operands[0], str):
            name, font = operands[0], fonts.get(operands[0])
        if font is not None and font.is_cid and op in SHOWN and len(operands) > SHOWN[op]:
            value, n = operands[SHOWN[op]], font.bytes_per_char
            raw = b"".join(x for x in value if isinstance(x, bytes)) if isinstance(value, list) else value if isinstance(value, bytes) else b""
            codes = struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) & ~1]) if n == 2 else [int.from_bytes(raw[k : k + n], "big") for k in range(0, len(raw) - n + 1, n)]
            yield p.number, seq, name, codes


def _shown_codes(d, only):
    """The codes of the strings that a page's own content shows in composite fonts."""
    r = PageReader(d)
    return _of_pages(d, only, lambda p: _codes_of_page(r, p))


def _page_codes(d, only):
    """shown_codes and code_maps of a page that shows any, in one row."""
    r = PageReader(d)

    def rows(p):
        shown = [{"seq": seq, "font_name": name, "codes": codes} for _, seq, name, codes in _codes_of_page(r, p)]
        names = {s["font_name"] for s in shown}
        maps = [dict(zip(("font_name", "first_code", "last_code", "to", "rank"), row)) for _, *row in _maps_of_page(r, p) if row[0] in names]
        return [(p.number, shown, maps)] if shown else []

    return _of_pages(d, only, rows)


def _whole_number(value):
    return value if isinstance(value, int) and int32(value) is not None else None


def _xobjects(d, p):
    known = []
    for name, value in (d.get(p.resources, "XObject", dict) or {}).items():
        s = d.resolve(value)
        if isinstance(s, Stream):
            known.append({"name": name, "subtype": d.get(s.dict, "Subtype", Name), "width": _whole_number(d.get(s.dict, "Width", int)), "height": _whole_number(d.get(s.dict, "Height", int))})
    return known


def _page_paints(d, only):
    """Of page_ops what places XObjects: `cm` and `Do`. No fonts are read, and of a page
    without images no content."""

    def rows(p):
        known, out = _xobjects(d, p), []
        if any(x["subtype"] == "Image" for x in known):
            for op, operands in operations(d.contents(p)):
                if op == b"cm":
                    out.append({"op": "cm", "nums": [v if isinstance(v, float) else 0.0 for v in operands], "name": None})
                elif op == b"Do":
                    out.append({"op": "Do", "nums": [], "name": operands[0] if operands and isinstance(operands[0], str) else None})
        yield p.number, out, known

    return _of_pages(d, only, rows, lambda p: [(p.number, [], [])])


#: Thousandths of the size that an adjustment moves back where a span, or a word, ends.
SPAN_GAP, WORD_GAP = -150, -100


def _page_steps(d, only):
    """Of page_ops what moves and shows text, in steps (see operators.content): 0 nothing
    more, 1 text, 2 size, 3 move, 4 place, 5 advance, and whether it ends the span before."""
    r = PageReader(d)
    step = lambda kind, ends, x=None, y=None, text=None: {"ends": ends, "kind": kind, "x": x, "y": y, "text": text}
    at = lambda v: v if isinstance(v, float) else 0.0

    def rows(p):
        out, font, fonts = [], None, r.fonts(p)
        for op, operands in operations(d.contents(p)):
            n = len(operands)
            if op in SHOWN:
                if (parts := shown(op, operands, font)) is not None:
                    if op == b"'" or op == b'"':
                        out.append(step(0, True))
                    out += [step(1, False, text=t) if t is not None else step(5, a < SPAN_GAP, a) for a, t in parts]
            elif op == b"Tm":
                if n >= 6:
                    out.append(step(4, True, at(operands[4]), at(operands[5])))
            elif op == b"Td" or op == b"TD":
                if n >= 2:
                    out.append(step(3, True, at(operands[0]), at(operands[1])))
            elif op == b"T*":
                out.append(step(0, True))
            elif op == b"Tf" and n >= 2:
                if isinstance(operands[0], str):
                    font = fonts.get(operands[0])
                out.append(step(2, False, at(operands[1])))
        yield p.number, out

    return _of_pages(d, only, rows, lambda p: [(p.number, [])])


def _page_marks(d, only):
    """Of page_ops what opens (1) and ends (-1) marks, with the ids that marks have, and the
    text that each operator shows (0)."""
    r = PageReader(d)

    def rows(p):
        out, font, fonts = [], None, r.fonts(p)
        for op, operands in operations(d.contents(p)):
            if op in SHOWN:
                if (parts := shown(op, operands, font)) is not None:
                    out.append({"way": 0, "mcid": None, "piece": "".join([t if t is not None else " " if a < WORD_GAP else "" for a, t in parts])})
            elif op == b"EMC":
                out.append({"way": -1, "mcid": None, "piece": None})
            elif op == b"BDC" and len(operands) >= 2:
                mcid = property_mcid(operands[1:])
                out.append({"way": 1, "mcid": mcid if mcid is not None and mcid >= 0 else None, "piece": None})
            elif op == b"BMC" and operands:
                out.append({"way": 1, "mcid": None, "piece": None})
            elif op == b"Tf" and len(operands) >= 2 and isinstance(operands[0], str):
                font = fonts.get(operands[0])
        yield p.number, out

    return _of_pages(d, only, rows, lambda p: [(p.number, [])])


def _page_ops(d, only):
    """The operators of each page's own content, with decoded text, and its XObjects."""
    r = PageReader(d)

    def rows(p):
        out, font, fonts = [], None, r.fonts(p)
        for op, operands in operations(d.contents(p)):
            if op == b"Tf" and len(operands) >= 2 and isinstance(operands[0], str):
                font = fonts.get(operands[0])
            name = operands[0] if operands and isinstance(operands[0], str) else None
            nums = [v if isinstance(v, float) else 0.0 for v in operands]
            out.append({"op": op.decode("latin-1"), "nums": nums, "name": name, "parts": pieces(op, operands, font), "mcid": property_mcid(operands[1:]) if op == b"BDC" else None})
        yield p.number, out, _xobjects(d, p)

    return _of_pages(d, only, rows, lambda p: [(p.number, [], [])])


#: Arrays in arrays are followed so deep.
NESTED = 20


def _entries(d, only):
    """What dictionaries hold, a row for each value or member of an array: of every object
    (by number), of the trailer (-1) and of dictionaries and arrays inside these, which
    get numbers from -2 down; an empty array is a row without a value. A reference stays one if it leads to a dictionary, else what
    it leads to stands for it."""
    numbers, todo, rows = itertools.count(-2, -1), [(-1, d.trailer)], []

    def add(obj, key, place, value, depth=0):
        found = d.resolve(value)
        if isinstance(found, Stream):
            found = found.dict
        if isinstance(found, dict):
            if not isinstance(value, Ref):
                todo.append((next_ := next(numbers), found))
            rows.append((obj, key, place, value.num if isinstance(value, Ref) else next_, None, None, None))
        elif isinstance(found, list) and depth < NESTED:
            own, name = (obj, key) if place is None else (next(numbers), "")
            if place is not None:
                rows.append((obj, key, place, own, None, None, None))
            for k, v in enumerate(found):
                add(own, name, k, v, depth + 1)
            if not found:
                rows.append((own, name, None, None, None, None, None))
        elif isinstance(found, bytes):
            rows.append((obj, key, place, None, None, found, None))
        elif isinstance(found, (int, float)):
            rows.append((obj, key, place, None, float(found), None, None))
        elif isinstance(found, str):
            rows.append((obj, key, place, None, None, None, found))

    for num in d.xref:
        found = d.resolve(Ref(num, 0))
        found = found.dict if isinstance(found, Stream) else found
        if isinstance(found, dict):
            todo.append((num, found))
    while todo:
        obj, entries = todo.pop()
        for key, value in entries.items():
            add(obj, key, None, value)
        yield from rows
        rows.clear()


def _document_entries(d, only):
    """All entries of a document in one row."""
    yield ([dict(zip(("obj", "key", "place", "ref", "num", "bytes", "name"), row)) for row in _entries(d, only)],)


def _page_text(d, only):
    r = PageReader(d)

    def rows(p):
        ops = r.ops(p)
        whole = stream_text(ops)
        yield p.number, whole, stream_text(ops, forms=False) if any(o.depth for o in ops) else whole

    return _of_pages(d, only, rows, lambda p: [(p.number, "", "")])


def _span_dicts(ops):
    return [{"seq": k, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "font_size": size} for k, (x0, y0, x1, y1, text, size) in enumerate(spans(ops))]


def _width(p):
    return p.media_box[2] - p.media_box[0]


def _page_spans(d, only):
    r = PageReader(d)
    return _of_pages(d, only, lambda p: [(p.number, _width(p), _span_dicts(r.ops(p, forms=False)))], lambda p: [(p.number, _width(p), [])])


def _order(d):
    return d.attempt(d.reading_order, [], kind="invalid_structure")


def _refs(d, only):
    seen: dict[int, int] = {}
    for page, mcid, kind in _order(d):
        k = seen[page] = seen.get(page, -1) + 1
        if only is None or page in only:
            yield page, k, mcid, kind


def _marked(d, only):
    r = PageReader(d)
    return _of_pages(d, only, lambda p: [(p.number, mcid, text) for mcid, text in marked_text(r.ops(p, forms=False)).items()])


def _refs_of_pages(d):
    refs: dict[int, list] = {}
    for page, mcid, kind in _order(d):
        refs.setdefault(page, []).append({"mcid": mcid, "struct_type": kind})
    return refs


def _all(d, only):
    r, refs = PageReader(d), _refs_of_pages(d)

    def rows(p):
        ops = r.ops(p, forms=False)
        own = refs.get(p.number, [])
        yield p.number, _width(p), d.has_structure, stream_text(ops, False), _span_dicts(ops), own, list(marked_text(ops).items()) if own else []

    return _of_pages(d, only, rows, lambda p: [(p.number, _width(p), d.has_structure, "", [], [], [])])


def _document_pages(d, only):
    """All pages of a document in one row, with what their text is chosen from."""
    r, refs = PageReader(d), _refs_of_pages(d)

    def page(p):
        ops, own = r.ops(p, forms=False), refs.get(p.number, [])
        return {"page": p.number, "plain": stream_text(ops, False), "refs": own, "marked": list(marked_text(ops).items()) if own else []}

    yield ([d.attempt(lambda: page(p), {"page": p.number, "plain": "", "refs": [], "marked": []}, p.number) for p in _pages(d, only)],)


def _texts_of_metadata(d):
    return [None if v is None else raw_text(v) for v in d.metadata()]


def _metadata(d, only):
    yield _texts_of_metadata(d)


def _outline(d, only):
    for k, (title, ref, level) in enumerate(d.attempt(d.outline, [], kind="invalid_outline")):
        yield k, title, d.page_of(ref), level


def _labels(d, only):
    yield from d.attempt(d.label_ranges, None, kind="invalid_labels") or []


def _links(d, only):
    return _of_pages(d, only, lambda p: [(p.number, k, *rect, uri, d.page_of(ref)) for k, (rect, uri, ref) in enumerate(d.links(p))])


def _images(d, only):
    r = PageReader(d)
    return _of_pages(d, only, lambda p: [(p.number, k, *rect, w, h) for k, (rect, w, h) in enumerate(r.images(p))])


def _form_fields(d):
    return d.attempt(d.form_fields, [], kind="invalid_form")


def _fields(d, only):
    for k, f in enumerate(_form_fields(d)):
        yield k, *f


def _info(d, only):
    sizes = [{"width": _width(p), "height": p.media_box[3] - p.media_box[1], "rotation": p.rotation} for p in _pages(d, only)]
    outline = [dict(zip(("ord", "title", "dest_page", "level"), row)) for row in _outline(d, only)]
    yield (len(d.data), len(d.pages), len(d.xref), d.encrypted, d.has_structure, len(_form_fields(d)), *_texts_of_metadata(d), sizes, outline)


def _whole(d, only):
    """All that an export of a document needs, pages with their text chosen."""
    r, refs = PageReader(d), _refs_of_pages(d)

    def page(p):
        ops = r.ops(p, forms=False)
        plain, own, marked = stream_text(ops, False), refs.get(p.number, []), marked_text(ops)
        tagged = " ".join(filter(None, (marked.get(x["mcid"]) for x in own)))
        enough = tagged and len(tagged.encode()) >= len(plain.encode()) * 6 // 10
        links = [{"uri": u, "dest_page": d.page_of(to), "rect": rect} for rect, u, to in d.links(p)]
        images = [{"rect": rect, "width": w, "height": h} for rect, w, h in r.images(p)]
        return {"page": p.number, "text": tagged if enough else plain, "links": links, "images": images}

    pages = [d.attempt(lambda: page(p), {"page": p.number, "text": "", "links": [], "images": []}, p.number) for p in _pages(d, only)]
    outline = [dict(zip(("ord", "title", "dest_page", "level"), row)) for row in _outline(d, only)]
    ranges = [dict(zip(("start", "style", "prefix", "first"), row)) for row in _labels(d, only)]
    yield (len(d.pages), *_texts_of_metadata(d), outline, ranges, pages)


def _errors(d, only):
    """Errors of opening the document, and of all that is read of it."""
    r = PageReader(d)
    for p in _pages(d, only):
        d.attempt(lambda: (stream_text(ops := r.ops(p)), spans(ops), marked_text(ops), list(r.images(p)), list(d.links(p))), None, p.number)
    for kernel in (_refs, _outline, _labels, _fields):
        list(kernel(d, None))
    for kind, offset, message, page in d.errors:
        yield kind, offset, message, page


KERNELS: dict[str, Callable[[Document, frozenset | None], Iterator]] = {
    "document": _document, "xref": _xref, "pages": _page_rows, "fonts": _fonts, "content_ops": _ops, "page_ops": _page_ops, "page_paints": _page_paints, "page_marks": _page_marks, "page_steps": _page_steps, "entries": _entries, "document_entries": _document_entries, "xref_sections": _xref_sections, "document_sections": _document_sections, "code_maps": _code_maps, "shown_codes": _shown_codes, "page_codes": _page_codes, "page_text": _page_text,
    "page_spans": _page_spans, "mcid_refs": _refs, "mcid_text": _marked, "page_all": _all, "metadata": _metadata, "outline": _outline,
    "font_widths": _font_widths, "info": _info, "whole": _whole, "document_pages": _document_pages, "label_ranges": _labels, "links": _links, "images": _images, "form_fields": _fields, "parse_errors": _errors,
}

#: Tables that are made of cross references alone; a document's pages are not looked for.
PAGELESS = {"xref", "xref_sections", "document_sections"}

#: Rows of a result batch, and bytes of the documents that they are read from: large enough
#: for Arrow, small enough for blobs and for rows with hundreds of spans each.
ROWS, BYTES = 2_000, 1 << 20


def schema_of(table: str) -> StructType:
    return _parse_datatype_string(TABLES[table])


def extract(files: DataFrame, table: str, *, pages: Sequence[int] | None = None, mode: str = "PERMISSIVE", rebuild: bool = False) -> DataFrame:
    """A table of TABLES from files (doc_id, content). The kernel reads only what
    that table needs; with `pages`, only those pages are interpreted. A page that
    fails keeps its row in tables with a row a page, with empty text, and the other
    pages are whole; every failure is a row of parse_errors, or with FAILFAST an
    error of the job. rebuild: files with damaged cross references are searched for
    objects. The content column goes no further than the kernel."""
    schema, kernel = schema_of(table), KERNELS[table]
    only, strict = None if pages is None else frozenset(pages), mode.upper() == "FAILFAST"
    arrow, paged = to_arrow_schema(schema), strict or table not in PAGELESS

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for b in batches:
            ids, contents = b.column(0), b.column(1)
            for k in range(b.num_rows):
                key, content = ids[k].as_py(), contents[k].as_py()
                try:
                    rows += [(key, *row) for row in kernel(Document(content or b"", strict, rebuild, paged), only)]
                except FAILURES as e:
                    if strict:
                        raise InvalidPdfError(f"{key}: {e}") from e
                    if table == "parse_errors":
                        rows.append((key, "kernel", 0, f"{type(e).__name__}: {e}", None))
                size += len(content or b"")
                if len(rows) >= ROWS or size >= BYTES and rows:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, arrow)

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, schema)


def _fits(value, kind: pa.DataType):
    """A value as its type can hold it: text without lone surrogates, whole numbers that
    are too large as null."""
    if value is None:
        return None
    if pa.types.is_string(kind):
        return value.encode("utf-8", "replace").decode()
    if pa.types.is_integer(kind):
        return value if -(1 << kind.bit_width - 1) <= value < 1 << kind.bit_width - 1 else None
    if pa.types.is_list(kind):
        return [_fits(v, kind.value_type) for v in value]
    if pa.types.is_map(kind):
        return [(_fits(k, kind.key_type), _fits(v, kind.item_type)) for k, v in value]
    if pa.types.is_struct(kind):
        return {f.name: _fits(value.get(f.name), f.type) for f in kind}
    return value


def _column(values, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowException, OverflowError, UnicodeError):
        return pa.array([_fits(v, kind) for v in values], kind)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id (the path), path, length, content of the files under a path."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("path").alias("doc_id"), "path", "length", "content")


def headers(files: DataFrame) -> DataFrame:
    """doc_id, is_pdf: whether the bytes start as a PDF must. No Python."""
    return files.select("doc_id", F.col("content").startswith(F.lit(b"%PDF-")).alias("is_pdf"))
