"""One PDF: cross references, objects, pages and document-level features.

Nothing here knows Spark. In permissive mode a document never raises: what goes
wrong is kept in `errors` (kind, offset, message, page) and whatever could be read
is given."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

from . import filters
from .objects import Name, Parser, PdfError, Ref, Stream, int32

#: Nodes of an outline or a tree that are looked at; more are an error row. Cycles end
#: by themselves, so only a file that shares nodes without end gets there.
VISITS = 1_000_000
#: What a damaged document may make the code below raise.
FAILURES = (ArithmeticError, AttributeError, LookupError, MemoryError, RecursionError, TypeError, ValueError)
DEFAULT_BOX = [0.0, 0.0, 612.0, 792.0]

_GAP = rb"[\x00\t\n\x0c\r ]+"
_SECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ \t]+(\d+)[ \t]*[\r\n]+")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[ ]+(\d{1,5})[ ]+([nf])")
#: Sections of one entry each, as many as follow one another.
_ONE = rb"[\x00\t\n\x0c\r ]*+(\d++)[ \t]++1[ \t]*+[\r\n]++[\x00\t\n\x0c\r ]*+(\d{1,10})[ ]++(\d{1,5})[ ]++([nf])"
_ONES, _EACH = re.compile(rb"(?:%s)*+" % _ONE), re.compile(_ONE)
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
_START = re.compile(rb"startxref[\x00\t\n\x0c\r ]*(\d+)")


#: Objects up to that many bytes are kept as parsed, the latest of them: those that a maker of
#: documents writes into each are parsed once. Nothing here changes what was parsed.
_SHORT, _KEPT = 512, 1024


@lru_cache(_KEPT)
def _short(raw: bytes) -> Any:
    """The object of bytes that end with endobj; an error where more bytes might change it."""
    parser = Parser(raw)
    value = parser.indirect()[1]
    if parser.pos > len(raw) - 6 or isinstance(value, Stream) and value.dict.get("Length") != len(value.data):
        raise PdfError("syntax", 0, "endobj inside an object")
    return value


def object_at(data: bytes, at: int) -> Any:
    """The indirect object that starts at a place."""
    end = data.find(b"endobj", at, at + _SHORT)
    if end >= 0:
        try:
            return _short(data[at : end + 6])
        except FAILURES:
            pass
    return Parser(data, at).indirect()[1]


class Entry(NamedTuple):
    kind: str
    offset: int
    gen_or_index: int


@dataclass
class Page:
    number: int
    ref: Ref | None
    dict: dict
    media_box: list[float]
    crop_box: list[float]
    rotation: int
    resources: dict = field(default_factory=dict)


def decode_text_string(raw: bytes) -> str:
    """UTF-16BE after FE FF, where a lone surrogate is U+FFFD (a high one takes the
    unit after it along) and an odd last byte is dropped; else Latin-1."""
    if not raw.startswith(b"\xfe\xff"):
        return raw.decode("latin-1")
    try:
        return raw[2 : len(raw) & ~1].decode("utf-16-be")
    except UnicodeDecodeError:
        units = [int.from_bytes(raw[k : k + 2], "big") for k in range(2, len(raw) - 1, 2)]
        out, k = [], 0
        while k < len(units):
            u, k = units[k], k + 1
            if 0xD800 <= u < 0xDC00:
                low = units[k] if k < len(units) else 0
                k += k < len(units)
                out.append(chr(0x10000 + ((u - 0xD800) << 10) + low - 0xDC00) if 0xDC00 <= low < 0xE000 else "�")
            else:
                out.append("�" if 0xDC00 <= u < 0xE000 else chr(u))
        return "".join(out)


def raw_text(raw: bytes) -> str:
    """Bytes shown as UTF-8, as the metadata of the API has them."""
    return raw.decode("utf-8", "replace")


class Document:
    def __init__(self, data: bytes | memoryview, strict: bool = False, rebuild: bool = False, paged: bool = True):
        """rebuild: where the cross references can't be read, the file is searched for
        objects. paged: whether its pages are wanted."""
        self.data = bytes(data)
        self.strict, self.errors = strict, []
        self.xref: dict[int, Entry] = {}
        #: Offset of each cross-reference section: that of the one before, and entries.
        self.sections: dict[int, tuple[int | None, list]] = {}
        self.trailer: dict = {}
        self.pages: list[Page] = []
        self._cache: dict[int, Any] = {}
        self._streams: dict[int, list] = {}
        self._busy: set[int] = set()
        self.encrypted = False
        if not self.data.startswith(b"%PDF-"):
            self._fail("invalid_header", 0, "no %PDF- at the start")
        try:
            self._read_xref()
        except FAILURES as e:
            self.xref, self.trailer, self.sections = {}, {}, {}
            self._fail("invalid_xref", getattr(e, "offset", 0), str(e))
            if not rebuild or not self._search_objects():
                return
        self.encrypted = "Encrypt" in self.trailer
        if self.encrypted:
            self._fail("encrypted", 0, "the document is encrypted")
        try:
            if paged:
                self._read_pages()
        except FAILURES as e:
            self.pages = []
            self._fail("invalid_page_tree", getattr(e, "offset", 0), str(e))

    def _fail(self, kind: str, offset: int, message: str, page: int | None = None) -> None:
        if (error := (kind, offset, message, page)) not in self.errors:
            self.errors.append(error)
        if self.strict:
            raise PdfError(kind, offset, message)

    def attempt(self, read: Callable, default: Any, page: int | None = None, kind: str = "invalid_stream") -> Any:
        """What read() gives; where it fails, an error of the page (or the document) and
        the default."""
        try:
            return read()
        except FAILURES as e:
            self._fail(kind, getattr(e, "offset", 0), f"{type(e).__name__}: {e}", page)
            return default

    def cut(self, what: str, page: int | None = None) -> None:
        """Note that a guard left out a part."""
        self._fail("limit", 0, what, page)

    # Cross references

    def _read_xref(self) -> None:
        """From the last startxref back along /Prev. The newest revision is read
        first, and the first entry of an object and the first trailer count."""
        tail = self.data.rfind(b"startxref", max(0, len(self.data) - 1024))
        m = _START.match(self.data, tail) if tail >= 0 else None
        if m is None:
            raise PdfError("invalid_xref", 0, "no startxref")
        at = int(m[1])
        while at is not None and at not in self.sections:
            entries: list[tuple[int, Entry]] = []
            trailer = (self._table if self.data[at : at + 4] == b"xref" else self._xref_stream)(at, entries)
            if not self.sections:
                self.trailer = dict(trailer)
            before = trailer.get("Prev")
            before = int(before) if isinstance(before, (int, float)) and 0 <= before < len(self.data) else None
            self.sections[at] = before, entries
            for num, entry in entries:
                self.xref.setdefault(num, entry)
            at = before

    def _table(self, at: int, entries: list) -> dict:
        pos = _ONES.match(self.data, at + 4).end()
        for num, offset, gen, kind in _EACH.findall(self.data, at + 4, pos):
            entries.append((int(num), Entry("in_use" if kind == b"n" else "free", int(offset), int(gen))))
        while m := _SECTION.match(self.data, pos):
            first, count, pos = int(m[1]), int(m[2]), m.end()
            for k in range(count):
                e = _ENTRY.match(self.data, pos)
                if e is None:
                    raise PdfError("invalid_xref", pos, "bad entry")
                pos = e.end()
                entries.append((first + k, Entry("in_use" if e[3] == b"n" else "free", int(e[1]), int(e[2]))))
        parser = Parser(self.data, pos)
        parser.skip()
        if not self.data.startswith(b"trailer", parser.pos):
            raise PdfError("invalid_xref", parser.pos, "no trailer")
        parser.pos += 7
        trailer = parser.parse()
        if not isinstance(trailer, dict):
            raise PdfError("invalid_xref", parser.pos, "trailer is no dictionary")
        return trailer

    def _xref_stream(self, at: int, entries: list) -> dict:
        if not 0 <= at < len(self.data):
            raise PdfError("invalid_xref", 0, "startxref outside the file")
        _, s = Parser(self.data, at).indirect()
        if not isinstance(s, Stream):
            raise PdfError("invalid_xref", at, "no cross-reference stream")
        body = filters.decode(s.data, s.dict.get("Filter"), s.dict.get("DecodeParms"))
        widths = s.dict.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths):
            raise PdfError("invalid_xref", at, "bad /W")
        w0, w1, w2 = widths[:3]
        ranges = s.dict.get("Index") if isinstance(s.dict.get("Index"), list) else [0, s.dict.get("Size", 0)]
        pos, step = 0, w0 + w1 + w2
        for first, count in zip(ranges[::2], ranges[1::2]):
            for num in range(first, first + count):
                row = body[pos : pos + step]
                if len(row) < step or not step:
                    return s.dict
                pos += step
                kind = int.from_bytes(row[:w0], "big") if w0 else 1
                a, b = int.from_bytes(row[w0 : w0 + w1], "big"), int.from_bytes(row[w0 + w1 :], "big")
                if kind in (0, 1, 2):
                    entries.append((num, Entry(("free", "in_use", "compressed")[kind], a, b)))
        return s.dict

    def _search_objects(self) -> bool:
        """Cross references from every `N G obj` of the file, later ones first; the
        trailer from the last dictionary after `trailer`, or a catalog."""
        for m in _OBJECT.finditer(self.data):
            self.xref[int(m[1])] = Entry("in_use", m.start(1), int(m[2]))
        for at in reversed([m.end() for m in re.finditer(rb"trailer", self.data)]):
            found = self.attempt(Parser(self.data, at).parse, None, kind="invalid_xref")
            if isinstance(found, dict) and "Root" in found:
                self.trailer = found
                break
        else:
            roots = [n for n in self.xref if self.get(self._object(n), "Type", Name) == "Catalog"]
            if roots:
                self.trailer = {"Root": Ref(roots[-1], 0)}
        return bool(self.trailer)

    # Objects

    def resolve(self, value: Any) -> Any:
        """What a reference stands for; null if that is free, missing or broken."""
        if type(value) is not Ref:
            return value
        hops = 0
        while isinstance(value, Ref) and hops < 32:
            value, hops = self._object(value.num), hops + 1
        return None if isinstance(value, Ref) else value

    def _object(self, num: int) -> Any:
        if num in self._cache:
            return self._cache[num]
        entry = self.xref.get(num)
        if entry is None or entry.kind == "free" or num in self._busy:
            return None
        self._busy.add(num)
        try:
            if entry.kind == "in_use":
                value = object_at(self.data, entry.offset) if entry.offset < len(self.data) else None
            else:
                value = self._compressed(num, entry)
        except FAILURES:
            value = None
        self._busy.discard(num)
        self._cache[num] = value
        return value

    def _compressed(self, num: int, entry: Entry) -> Any:
        members = self._streams.get(entry.offset)
        if members is None:
            s = self.resolve(Ref(entry.offset, 0))
            if not isinstance(s, Stream):
                return None
            body, first = self.stream_data(s), s.dict.get("First", 0)
            heads = [int(x) for x in body[:first].split()[: 2 * s.dict.get("N", 0)]]
            members = self._streams[entry.offset] = [(n, body, first + at) for n, at in zip(heads[::2], heads[1::2])]
        for place, (n, body, at) in enumerate(members):
            if n == num and (place == entry.gen_or_index or all(m[0] != num for m in members[entry.gen_or_index : entry.gen_or_index + 1])):
                return Parser(body, at).parse()
        return None

    def stream_data(self, s: Stream) -> bytes:
        return filters.decode(s.data, self._deep(s.dict.get("Filter")), self._deep(s.dict.get("DecodeParms")))

    def _deep(self, value: Any) -> Any:
        value = self.resolve(value)
        return [self.resolve(v) for v in value] if isinstance(value, list) else value

    def get(self, entries: Any, key: str, kind: type | tuple) -> Any:
        """entries[key], resolved, if it has the kind asked for."""
        value = entries.get(key) if isinstance(entries, dict) else None
        if type(value) is Ref:
            value = self.resolve(value)
        return value if isinstance(value, kind) and not (isinstance(value, bool) and kind is not bool) else None

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        return root if isinstance(root, dict) else {}

    # Pages

    def _box(self, entries: dict, key: str) -> list[float] | None:
        box = self.get(entries, key, list)
        if not box:
            return None
        box = [self.resolve(x) for x in box]
        return [float(x) for x in box] if box and len(box) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in box) else None

    def _read_pages(self) -> None:
        if not self.catalog:
            raise PdfError("invalid_page_tree", 0, "no catalog")
        root = self.catalog.get("Pages")
        if not isinstance(self.resolve(root), dict):
            raise PdfError("invalid_page_tree", 0, "no page tree")
        walk: list[tuple[Any, dict, frozenset]] = [(root, {}, frozenset())]
        while walk:
            ref, inherited, above = walk.pop()
            node = self.resolve(ref)
            if not isinstance(node, dict):
                if not isinstance(ref, Ref):
                    self._fail("invalid_page_tree", 0, "a kid is no reference")
                    continue
                raise PdfError("invalid_page_tree", 0, "a node is no dictionary")
            if isinstance(ref, Ref):
                if ref.num in above:
                    raise PdfError("invalid_page_tree", 0, "the tree has a cycle")
                above = above | {ref.num}
            own = dict(inherited)
            for key in ("MediaBox", "CropBox"):
                if box := self._box(node, key):
                    own[key] = box
            if (turn := self.get(node, "Rotate", int)) is not None and int32(turn) is not None:
                own["Rotate"] = turn
            if (resources := self.get(node, "Resources", dict)) is not None:
                own["Resources"] = resources
            kind = self.get(node, "Type", Name) or ("Pages" if "Kids" in node else "Page")
            if kind == "Pages":
                kids = self.get(node, "Kids", list)
                if kids is None:
                    self._fail("invalid_page_tree", 0, "a node has no kids")
                    continue
                walk += [(k, own, above) for k in reversed(kids)]
            elif kind != "Page":
                self._fail("invalid_page_tree", 0, f"a node of type {kind} is no page")
            else:
                media = own.get("MediaBox", DEFAULT_BOX)
                self.pages.append(Page(len(self.pages), ref if isinstance(ref, Ref) else None, node, media, own.get("CropBox", media), own.get("Rotate", 0), own.get("Resources", {})))

    def contents(self, page: Page) -> bytes:
        """The page's content. Parts of an array are each followed by a line end; a
        stream that can't be decoded is taken as it is."""
        value = self.resolve(page.dict.get("Contents"))
        if isinstance(value, Stream):
            return self._content(value)
        if isinstance(value, list):
            return b"".join(self._content(s) + b"\n" for v in value if isinstance(s := self.resolve(v), Stream))
        return b""

    def _content(self, s: Stream) -> bytes:
        try:
            return self.stream_data(s)
        except FAILURES:
            return s.data

    def page_of(self, ref: Any) -> int | None:
        if isinstance(ref, Ref):
            return self._by_ref().get(ref)
        return None

    def _by_ref(self) -> dict[Ref, int]:
        if not hasattr(self, "_places"):
            self._places: dict[Ref, int] = {}
            for p in self.pages:
                if p.ref is not None:
                    self._places.setdefault(p.ref, p.number)
        return self._places

    # Features

    METADATA = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")

    def metadata(self) -> list[bytes | None]:
        info = self.resolve(self.trailer.get("Info"))
        return [v if isinstance(v := info.get(k), bytes) else None for k in self.METADATA] if isinstance(info, dict) else [None] * 8

    def destination(self, value: Any) -> Any:
        """The page reference of an explicit destination; named ones stay unresolved."""
        value = self.resolve(value)
        return value[0] if isinstance(value, list) and value and isinstance(value[0], Ref) else None

    def _target(self, entries: dict) -> Any:
        if "Dest" in entries:
            return self.destination(entries["Dest"])
        action = self.get(entries, "A", dict)
        return self.destination(action.get("D")) if action and self.get(action, "S", Name) == "GoTo" else None

    def outline(self) -> list[tuple[str, Ref | None, int]]:
        """title, page reference, level in reading order."""
        out: list = []
        top = self.get(self.catalog, "Outlines", dict)
        stack, seen = [(top.get("First"), 0)] if top else [], set()
        while stack:
            if len(out) >= VISITS:
                self.cut("the outline goes on")
                break
            ref, level = stack.pop()
            item = self.resolve(ref)
            if not isinstance(item, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            title = self.get(item, "Title", bytes)
            out.append((decode_text_string(title or b""), self._target(item), level))
            stack.append((item.get("Next"), level))
            stack.append((item.get("First"), level + 1))
        return out

    def label_ranges(self) -> list[tuple[int, str | None, str | None, int]] | None:
        """start, style, prefix, first number of each range of page labels; None if
        the document has no labels. Subtrees are walked."""
        tree = self.get(self.catalog, "PageLabels", dict)
        if tree is None:
            return None
        out, stack, seen = [], [tree], set()
        while stack:
            node = stack.pop()
            if isinstance(node, Ref):
                if node in seen:
                    continue
                seen.add(node)
                node = self.resolve(node)
            if not isinstance(node, dict):
                continue
            nums = self.get(node, "Nums", list) or []
            for start, value in zip(nums[::2], nums[1::2]):
                label = self.resolve(value)
                if isinstance(start, int) and 0 <= start < 1 << 31 and isinstance(label, dict):
                    prefix, first = self.get(label, "P", bytes), self.get(label, "St", int)
                    out.append((start, self.get(label, "S", Name), None if prefix is None else raw_text(prefix), max(0, first if first is not None and int32(first) is not None else 1)))
            stack += reversed(self.get(node, "Kids", list) or [])
        return out

    def _rect(self, entries: dict) -> list[float] | None:
        r = self.get(entries, "Rect", list)
        r = [self.resolve(x) for x in r] if r else []
        return [float(x) for x in r[:4]] if len(r) >= 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in r[:4]) else None

    def links(self, page: Page) -> Iterator[tuple[list[float], str | None, Ref | None]]:
        for value in self.get(page.dict, "Annots", list) or []:
            note = self.resolve(value)
            if not isinstance(note, dict) or self.get(note, "Subtype", Name) != "Link" or (rect := self._rect(note)) is None:
                continue
            uri = target = None
            action = self.get(note, "A", dict)
            if action is not None:
                kind = self.get(action, "S", Name)
                if kind == "URI":
                    raw = self.get(action, "URI", bytes)
                    uri = None if raw is None else raw_text(raw)
                elif kind == "GoTo":
                    target = self.destination(action.get("D"))
            if uri is None and target is None and "Dest" in note:
                target = self.destination(note["Dest"])
            yield rect, uri, target

    KINDS = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}

    def form_fields(self) -> list[tuple[str, str | None, str, list[float] | None]]:
        """name (dotted), value, type, rectangle of each field without kids."""
        form, out = self.get(self.catalog, "AcroForm", dict), []
        stack, visits = [(f, "", frozenset()) for f in reversed(self.get(form, "Fields", list) or [])] if form else [], 0
        while stack:
            ref, parent, above = stack.pop()
            entries, visits = self.resolve(ref), visits + 1
            if not isinstance(entries, dict) or isinstance(ref, Ref) and ref in above:
                continue
            if visits > VISITS:
                self.cut("form fields go on")
                break
            own = raw_text(self.get(entries, "T", bytes) or b"")
            name = f"{parent}.{own}" if parent and own else own or parent
            if "Kids" in entries:
                kids = self.get(entries, "Kids", list) or []
                stack += [(k, name, above | {ref} if isinstance(ref, Ref) else above) for k in reversed(kids)]
                continue
            value = self.get(entries, "V", bytes)
            out.append((name, None if value is None else raw_text(value), self.KINDS.get(self.get(entries, "FT", Name), "unknown"), self._rect(entries)))
        return out

    def reading_order(self) -> list[tuple[int, int, str]]:
        """page, MCID, structure type in the order of the structure tree, artifacts
        left out; only marks on pages of the document."""
        root = self.get(self.catalog, "StructTreeRoot", dict)
        out: list[tuple[int, int, str]] = []
        if root is None:
            return out
        stack: list[tuple[Any, Any, str, frozenset]] = [(root.get("K"), None, "", frozenset())]
        visits = 0
        while stack:
            value, page, kind, above = stack.pop()
            if isinstance(value, Ref) and value in above:
                continue
            visits += 1
            if visits > VISITS:
                self.cut("the structure tree goes on")
                break
            inside = above | {value} if isinstance(value, Ref) else above
            node = self.resolve(value)
            if isinstance(node, list):
                stack += [(v, page, kind, inside) for v in reversed(node)]
            elif isinstance(node, int) and not isinstance(node, bool):
                if (at := self.page_of(page)) is not None and int32(node) is not None:
                    out.append((at, node, kind))
            elif isinstance(node, dict):
                page = node.get("Pg", page)
                tag = self.get(node, "Type", Name)
                if tag == "MCR" or (tag is None and "MCID" in node):
                    if (mcid := self.get(node, "MCID", int)) is not None and int32(mcid) is not None and (at := self.page_of(page)) is not None:
                        out.append((at, mcid, kind))
                elif tag != "OBJR" and (own := self.get(node, "S", Name) or "") != "Artifact":
                    stack.append((node.get("K"), page, own, inside))
        return out

    @property
    def has_structure(self) -> bool:
        return "StructTreeRoot" in self.catalog
