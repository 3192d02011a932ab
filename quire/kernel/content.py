"""Content streams: operators with their operands, and what they show.

A page is interpreted once. The result has its text operators in order (fonts
already applied), from which text in stream order, spans with positions and the
text of marked content all follow."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from .document import FAILURES, Document, Page
from .fonts import Font, decode_without_font, page_fonts
from .objects import Name, PdfError, Stream, hex_bytes, int32, literal_string, real, reals, unescape_name

#: Forms nest no deeper, and a page paints no more of them: an error row says so.
FORMS, PAINTED = 10, 20_000

_TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]*+(?:(?P<gap>%[^\r\n]*)"
    rb"|(?P<run>(?:[+-]?(?:\d++\.?\d*+|\.\d++)[\t\n\x0c\r ]++){2,})"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$|[-+A-Za-z'\"]))"
    rb"|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<op>[A-Za-z'\"][^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<string>\()|(?P<skip><<|>>|[\]{})])|(?P<hex><[^>]*>?)|(?P<array>\[)|(?P<other>.))",
    re.S,
)
_PLAIN = re.compile(rb"\(([^()\\]*)\)")
_GAP, _NUMBER, _REGULAR = rb"[\t\n\x0c\r ]", rb"[+-]?(?:\d++\.?\d*+|\.\d++)", rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*+"
#: An operator with operands of the usual kinds, in one match: 1 numbers; 2 a string without
#: escapes; 3 an array of these; 4 a name, and after it 5 a key and 6 its number in a
#: dictionary, 7 a name or 8 numbers; 9 the operator.
_USUAL = re.compile(
    rb"G*+(?:((?:NG++)++)|\(([^()\\]*+)\)G*+|\[((?:G*+(?:\([^()\\]*+\)|N(?=[\t\n\x0c\r (\]])))*+)G*+\]G*+"
    rb"|/(R)(?:G*+<<G*+/(R)G++(N)G*+>>G*+|G*+/(R)G++|G++((?:NG++)*+)))?+([A-Za-z'\"]R)".replace(b"G", _GAP).replace(b"N", _NUMBER).replace(b"R", _REGULAR)
)
_ITEM = re.compile(rb"\(([^()\\]*+)\)|(%s)" % _NUMBER)
_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")


def operations(data: bytes) -> Iterator[tuple[bytes, list]]:
    """Operators and their operands: floats, bytes for strings, names, lists.
    Dictionaries flatten into their keys and values. Inline images are passed by."""
    at, usual = 0, _USUAL.match
    while True:
        m = usual(data, at)
        if m is None or m[9] == b"BI":
            if (found := _operation(data, at)) is None:
                return
            op, operands, at = found
            if op is not None:
                yield op, operands
            continue
        numbers, text, array, name, key, value, second, after, op = m.groups()
        at = m.end()
        if numbers is not None:
            yield op, reals(numbers.split())
        elif text is not None:
            yield op, [text]
        elif array is not None:
            yield op, [[real(n) if n else t for t, n in _ITEM.findall(array)]]
        elif name is None:
            yield op, []
        elif after:
            yield op, [unescape_name(name), *reals(after.split())]
        elif key is not None:
            yield op, [unescape_name(name), unescape_name(key), real(value)]
        else:
            yield op, [unescape_name(name)] if second is None else [unescape_name(name), unescape_name(second)]


def _operation(data: bytes, at: int) -> tuple[bytes | None, list, int] | None:
    """The next operator, whatever its operands, and where it ends; no operator for an inline
    image, and None if there are no more."""
    end, operands, array = len(data), [], None
    match = _TOKEN.match
    while at < end:
        m = match(data, at)
        if m is None:  # only a gap is left
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "gap" or kind == "skip" or kind == "other":
            if array is not None and m["skip"] == b"]":
                operands.append(array)
                array = None
            continue
        if kind == "op":
            if array is not None:
                continue
            op = m["op"]
            if op == b"BI":
                stop = _IMAGE_END.search(data, at)
                return None, [], stop.end() if stop else end
            return op, operands, at
        if kind == "run":  # numbers, each with a gap after it
            (operands if array is None else array).extend(reals(m["run"].split()))
            continue
        if kind == "number":
            value: Any = real(m["number"])
        elif kind == "name":
            value = unescape_name(m["name"])
        elif kind == "string":
            if p := _PLAIN.match(data, at - 1):
                value, at = p[1], p.end()
            else:
                try:
                    value, at = literal_string(data, at - 1)
                except PdfError:
                    return None
        elif kind == "hex":
            value = hex_bytes(m["hex"][1:].rstrip(b">"))
        else:
            if array is None:
                array = []
            continue
        (operands if array is None else array).append(value)
    return None


def _num(value: Any) -> float:
    return value if isinstance(value, float) else 0.0


#: Operators that show text, and which operand they show.
SHOWN = {b"Tj": 0, b"TJ": 0, b"'": 0, b'"': 2}


def shown(op: bytes, operands: list, font: Font | None) -> list[tuple[float | None, str | None]] | None:
    """What an operator shows: (adjustment, None) and (None, decoded string); None if it
    shows none."""
    at = SHOWN.get(op)
    if at is None or len(operands) <= at:
        return None
    decode, value = font.decode if font else decode_without_font, operands[at]
    if op != b"TJ":
        return [(None, decode(value))] if isinstance(value, bytes) else []
    return [(None, decode(x)) if isinstance(x, bytes) else (x, None) for x in value if isinstance(x, (bytes, float))] if isinstance(value, list) else []


def pieces(op: bytes, operands: list, font: Font | None) -> list[dict] | None:
    """What an operator shows, as rows."""
    parts = shown(op, operands, font)
    return None if parts is None else [{"adjust": a, "text": t} for a, t in parts]


@dataclass(slots=True)
class Op:
    """One operator that matters for text. frame numbers the content stream it
    stands in (0: the page's own, others: forms, at `depth`). parts are the pieces
    of a shown string: (adjustment, None) or (None, text)."""

    seq: int
    frame: int
    depth: int
    op: str
    x: float | None = None
    y: float | None = None
    size: float | None = None
    parts: list[tuple[float | None, str | None]] | None = None
    mcid: int | None = None
    wmode: int = 0


@dataclass
class PageReader:
    """Interprets pages of a document; fonts are read once for the document."""

    doc: Document
    shared: dict = field(default_factory=dict)

    def fonts(self, page: Page) -> dict[str, Font]:
        return page_fonts(self.doc, page.resources, self.shared)

    def ops(self, page: Page, forms: bool = True) -> list[Op]:
        out: list[Op] = []
        content = self.doc.contents(page)
        if content:
            self._frames, self._page = 0, page.number
            self._run(content, page.resources, self.fonts(page), 0, 0, out, forms)
        return out

    def _form(self, name: str, resources: dict) -> tuple[bytes, dict] | None:
        s = self.doc.resolve((self.doc.get(resources, "XObject", dict) or {}).get(name))
        if not isinstance(s, Stream) or self.doc.get(s.dict, "Subtype", Name) != "Form":
            return None
        try:
            return self.doc.stream_data(s), self.doc.get(s.dict, "Resources", dict) or resources
        except FAILURES as e:
            self.doc.cut(f"a form can't be read: {e}", self._page)
            return None

    def _run(self, content: bytes, resources: dict, fonts: dict[str, Font], frame: int, depth: int, out: list[Op], forms: bool) -> None:
        font: Font | None = None
        marks: list[int | None] = []  # the innermost id outside each mark
        mcid, wmode = None, 0

        def add(op, x=None, y=None, size=None, parts=None):
            out.append(Op(len(out), frame, depth, op, x, y, size, parts, mcid, wmode))

        for raw, operands in operations(content):
            n = len(operands)
            if raw in SHOWN and (parts := shown(raw, operands, font)) is not None:
                add(raw.decode(), parts=parts)
            elif raw == b"Tm" and n >= 6:
                add("Tm", _num(operands[4]), _num(operands[5]))
            elif raw in (b"Td", b"TD") and n >= 2:
                add(raw.decode(), _num(operands[0]), _num(operands[1]))
            elif raw == b"Tf" and n >= 2:
                if isinstance(operands[0], str):
                    font = fonts.get(operands[0])
                    wmode = font.wmode if font else 0
                add("Tf", size=_num(operands[1]))
            elif raw == b"T*":
                add("T*")
            elif raw == b"BDC" and n >= 2:
                own = property_mcid(operands[1:])
                marks.append(mcid)
                mcid = own if own is not None and own >= 0 else mcid
            elif raw == b"BMC" and n >= 1:
                marks.append(mcid)
            elif raw == b"EMC":
                if marks:
                    mcid = marks.pop()
            elif raw == b"Do" and forms and n >= 1 and isinstance(operands[0], str):
                if form := self._form(operands[0], resources):
                    if depth >= FORMS or self._frames >= PAINTED:
                        self.doc.cut("forms nest too deep or are too many", self._page)
                        continue
                    self._frames += 1
                    self._run(form[0], form[1], fonts, self._frames, depth + 1, out, forms)

    def images(self, page: Page) -> Iterator[tuple[list[float], int, int]]:
        """rectangle, width and height of images that the page itself paints. The
        matrix is the product of all `cm` before."""
        m = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        named = self.doc.get(page.resources, "XObject", dict) or {}
        for op, operands in operations(self.doc.contents(page)):
            if op == b"cm" and len(operands) >= 6:
                m = multiply([_num(v) for v in operands[:6]], m)
            elif op == b"Do" and operands and isinstance(operands[0], str):
                s = self.doc.resolve(named.get(operands[0]))
                if isinstance(s, Stream) and self.doc.get(s.dict, "Subtype", Name) == "Image":
                    w, h = self.doc.get(s.dict, "Width", int), self.doc.get(s.dict, "Height", int)
                    if w is not None and h is not None and int32(w) is not None and int32(h) is not None:
                        yield [m[4], m[5], m[4] + m[0], m[5] + m[3]], w, h


def multiply(a, b) -> tuple:
    """The product of two affine matrices of six numbers."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def property_mcid(properties: list) -> int | None:
    """The number after an inline /MCID; named property lists have none."""
    for key, value in zip(properties, properties[1:]):
        if key == "MCID" and isinstance(value, float):
            return int32(int(value))
    return None




def stream_text(ops: list[Op], forms: bool = True) -> str:
    """Text in stream order. A line ends at T*, ' and ", and where Td, TD or Tm move
    across lines by over 0.7 of the larger of the font's size and the size of the
    text shown last, unless nothing was placed before."""
    out: list[str] = []
    states: dict[int, list[float]] = {}
    for o in ops:
        if o.depth and not forms:
            continue
        s = states.get(o.frame)
        if s is None:
            s = states[o.frame] = [12.0, 12.0, 0.0, 0.0]  # size, size shown last, x, y
        kind = o.op
        if o.parts is not None:
            if kind == "'" or kind == '"':
                out.append("\n")
            for adjust, text in o.parts:
                if text is not None:
                    out.append(text)
                elif adjust < -100:
                    out.append(" ")
            s[1] = s[0]
        elif kind == "Tf":
            s[0] = o.size
        elif kind == "T*":
            out.append("\n")
        elif kind == "Tm":
            now, before = (o.x, s[2]) if o.wmode == 1 else (o.y, s[3])
            if before != 0 and abs(now - before) > 0.7 * max(s[0], s[1]):
                out.append("\n")
            s[2], s[3] = o.x, o.y
        else:
            if s[3] != 0 and abs(o.x if o.wmode == 1 else o.y) > 0.7 * max(s[0], s[1]):
                out.append("\n")
            s[3] = o.y
    return "".join(out)


def spans(ops: list[Op]) -> list[tuple[float, float, float, float, str, float]]:
    """x0, y0, x1, y1, text, size of runs of text that nothing moved apart, forms
    left out. Half the size is taken for a byte's width."""
    out: list[tuple] = []
    x = y = cx = cy = 0.0
    size, held = 12.0, []

    def flush():
        nonlocal cx
        text = "".join(held)
        if text:
            width = len(text.encode()) * size * 0.5
            out.append((cx, cy, cx + width, cy + size * 1.2, text, size))
            cx += width
        held.clear()

    for o in ops:
        if o.depth:
            continue
        if o.parts is not None:
            if o.op in ("'", '"'):
                flush()
            for adjust, text in o.parts:
                if text is not None:
                    held.append(text)
                else:
                    if adjust < -150:
                        flush()
                    cx += -adjust / 1000.0 * size
        elif o.op == "Tf":
            size = o.size
        elif o.op == "T*":
            flush()
        else:
            x, y = (o.x, o.y) if o.op == "Tm" else (x + o.x, y + o.y)
            flush()
            cx, cy = x, y
    flush()
    return out


def marked_text(ops: list[Op]) -> dict[int, str]:
    """Text of each marked-content id in stream order, forms left out."""
    out: dict[int, list[str]] = {}
    for o in ops:
        if o.parts is not None and o.mcid is not None and not o.depth:
            piece = "".join(t if t is not None else " " if a < -100 else "" for a, t in o.parts)
            if piece:
                out.setdefault(o.mcid, []).append(piece)
    return {k: "".join(v) for k, v in out.items()}
