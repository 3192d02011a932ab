"""Writes small PDFs. Tests and queries make their inputs with it."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence


def escape(text: str | bytes, encoding: str = "cp1252") -> bytes:
    raw = text.encode(encoding, "replace") if isinstance(text, str) else text
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n")


def show_lines(lines: Iterable[str], x: float = 72, y: float = 720, size: float = 12, lead: float = 14, font: str = "F1", hexa: str | None = None) -> bytes:
    """A text object with one Tj a line; hexa: an encoding for hex strings."""
    out = [b"BT", b"/%s %g Tf" % (font.encode(), size), b"%g %g Td" % (x, y)]
    for k, line in enumerate(lines):
        if k:
            out.append(b"0 %g Td" % -lead)
        out.append(b"<%s> Tj" % line.encode(hexa).hex().encode() if hexa else b"(%s) Tj" % escape(line))
    return b"\n".join([*out, b"ET"])


HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


class Writer:
    """Objects by number; save() adds header, cross references and trailer."""

    def __init__(self):
        self.bodies: dict[int, bytes] = {}
        self.last = 0

    def reserve(self) -> int:
        self.last += 1
        return self.last

    def put(self, body: bytes, num: int | None = None) -> int:
        num = self.reserve() if num is None else num
        self.bodies[num] = body
        return num

    def stream(self, data: bytes, entries: bytes = b"", num: int | None = None, flate: bool = False) -> int:
        if flate:
            data, entries = zlib.compress(data), entries + b" /Filter /FlateDecode"
        return self.put(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), entries, data), num)

    def save(self, root: int, trailer: bytes = b"", packed: Iterable[int] = (), before: bytes = b"", only: Iterable[int] | None = None) -> bytes:
        """packed: objects to put in an object stream, which makes the cross
        references a stream. before: an earlier revision to which `only` is added."""
        out = bytearray(before or b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
        packed = [n for n in packed if n in self.bodies]
        entries: dict[int, tuple[int, int, int]] = {}
        extra = b""
        if before:
            extra = b" /Prev %d" % int(before[before.rindex(b"startxref") + 9 :].split()[0])
        for num in sorted(self.bodies if only is None else only):
            if num not in packed:
                entries[num] = (1, len(out), 0)
                out += b"%d 0 obj\n%s\nendobj\n" % (num, self.bodies[num])
        if packed:
            heads, body = [], b""
            for num in packed:
                heads.append(b"%d %d" % (num, len(body)))
                body += self.bodies[num] + b" "
            head = b" ".join(heads) + b" "
            data = zlib.compress(head + body)
            holder, table = self.last + 1, self.last + 2
            entries |= {num: (2, holder, k) for k, num in enumerate(packed)}
            entries[holder] = (1, len(out), 0)
            out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (holder, len(packed), len(head), len(data), data)
            start = len(out)
            entries[table] = (1, start, 0)
            entries[0] = (0, 0, 65535)
            nums = sorted(entries)
            rows = b"".join(bytes([entries[n][0]]) + entries[n][1].to_bytes(4, "big") + entries[n][2].to_bytes(2, "big") for n in nums)
            index = b" ".join(b"%d 1" % n for n in nums)
            data = zlib.compress(rows)
            out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Index [%s] /Root %d 0 R%s%s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (table, table + 1, index, root, trailer, extra, len(data), data)
        else:
            start = len(out)
            nums = sorted(entries)
            out += b"xref\n"
            if not before:
                out += b"0 1\n0000000000 65535 f \n"
            for num in nums:
                out += b"%d 1\n%010d %05d n \n" % (num, entries[num][1], 0)
            out += b"trailer\n<< /Size %d /Root %d 0 R%s%s >>\n" % (self.last + 1, root, trailer, extra)
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def simple_pdf(
    contents: Sequence[bytes],
    *,
    fonts: dict[str, bytes] | None = None,
    boxes: Sequence[Sequence[float]] | None = None,
    rotations: Sequence[int] | None = None,
    info: dict[str, str | bytes] | None = None,
    outline: Sequence[tuple[str | bytes, int | None, int]] = (),
    labels: Sequence[tuple[int, bytes]] = (),
    links: Sequence[Sequence[tuple[Sequence[float], bytes]]] = (),
    images: Sequence[tuple[int, int]] = (),
    fields: Sequence[bytes] = (),
    forms: dict[str, bytes] | None = None,
    structure: Sequence[tuple[int, int, str]] | None = None,
    filters: bytes = b"",
    encode=None,
    encrypt: bool = False,
    packed: bool = False,
    header: bool = True,
) -> bytes:
    """A document with one page for each content. Bodies of fonts, actions, labels
    and fields are given as PDF syntax; `{page:N}` in a link stands for page N.

    outline: title, page, level. forms: named form bodies that may paint each other.
    structure: page, MCID, type in reading order. encode: filters a content, which
    `filters` declares. packed: object and cross-reference streams."""
    w = Writer()
    root, tree = w.reserve(), w.reserve()
    resources = w.reserve()
    numbers = [w.reserve() for _ in contents]
    font_refs = b" ".join(b"/%s %d 0 R" % (name.encode(), w.put(body)) for name, body in (fonts or {"F1": HELVETICA}).items())
    forms_numbers = {name: w.reserve() for name in forms or {}}
    xobjects = [b"/%s %d 0 R" % (name.encode(), n) for name, n in forms_numbers.items()]
    for name, n in forms_numbers.items():
        w.stream(forms[name], b"/Type /XObject /Subtype /Form /BBox [0 0 612 792]", n)
    for k, (width, height) in enumerate(images):
        xobjects.append(b"/Im%d %d 0 R" % (k, w.stream(b"\0", b"/Type /XObject /Subtype /Image /Width %d /Height %d" % (width, height))))
    w.put(b"<< /Font << %s >> /XObject << %s >> >>" % (font_refs, b" ".join(xobjects)), resources)
    for k, content in enumerate(contents):
        body = w.stream(encode(content) if encode else content, filters)
        box = boxes[k] if boxes else (0, 0, 612, 792)
        notes = b""
        if k < len(links) and links[k]:
            refs = []
            for rect, action in links[k]:
                for p, n in enumerate(numbers):
                    action = action.replace(b"{page:%d}" % p, b"%d 0 R" % n)
                refs.append(b"%d 0 R" % w.put(b"<< /Type /Annot /Subtype /Link /Rect [%s] %s >>" % (b" ".join(b"%g" % v for v in rect), action)))
            notes = b" /Annots [%s]" % b" ".join(refs)
        turn = b" /Rotate %d" % rotations[k] if rotations and rotations[k] else b""
        w.put(b"<< /Type /Page /Parent %d 0 R /MediaBox [%s] /Contents %d 0 R%s%s >>" % (tree, b" ".join(b"%g" % v for v in box), body, notes, turn), numbers[k])
    w.put(b"<< /Type /Pages /Kids [%s] /Count %d /Resources %d 0 R >>" % (b" ".join(b"%d 0 R" % n for n in numbers), len(numbers), resources), tree)
    more = b""
    if outline:
        more += b" /Outlines %d 0 R" % _outline(w, outline, numbers)
    if labels:
        more += b" /PageLabels << /Nums [%s] >>" % b" ".join(b"%d << %s >>" % x for x in labels)
    if fields:
        more += b" /AcroForm << /Fields [%s] >>" % b" ".join(b"%d 0 R" % w.put(f) for f in fields)
    if structure is not None:
        kids = b" ".join(b"<< /Type /StructElem /S /%s /Pg %d 0 R /K %d >>" % (kind.encode(), numbers[p], mcid) for p, mcid, kind in structure)
        more += b" /MarkInfo << /Marked true >> /StructTreeRoot << /Type /StructTreeRoot /K << /Type /StructElem /S /Document /K [%s] >> >>" % kids
    w.put(b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, more), root)
    trailer = b""
    if info:
        trailer += b" /Info %d 0 R" % w.put(b"<< %s >>" % b" ".join(b"/%s (%s)" % (k.encode(), escape(v, "utf-8")) for k, v in info.items()))
    if encrypt:
        trailer += b" /Encrypt << /Filter /Standard /V 1 >>"
    plain = [n for n, body in w.bodies.items() if b"stream\n" not in body] if packed else []
    data = w.save(root, trailer, plain)
    return data if header else b"%XXX-" + data[5:]


def _outline(w: Writer, items: Sequence[tuple], pages: Sequence[int]) -> int:
    top = w.reserve()
    numbers = [w.reserve() for _ in items]
    parents: list[int] = []
    of = []
    for k, (_, _, level) in enumerate(items):
        del parents[level:]
        of.append(parents[-1] if parents else None)
        parents.append(k)
    for k, (title, page, _) in enumerate(items):
        family = [j for j in range(len(items)) if of[j] == of[k]]
        later = [j for j in family if j > k]
        kids = [j for j in range(len(items)) if of[j] == k]
        raw = title if isinstance(title, bytes) else title.encode("latin-1") if all(ord(c) < 256 for c in title) else b"\xfe\xff" + title.encode("utf-16-be")
        body = b"/Title <%s> /Parent %d 0 R" % (raw.hex().encode(), top if of[k] is None else numbers[of[k]])
        if page is not None:
            body += b" /Dest [%d 0 R /Fit]" % pages[page]
        if later:
            body += b" /Next %d 0 R" % numbers[later[0]]
        if kids:
            body += b" /First %d 0 R /Last %d 0 R" % (numbers[kids[0]], numbers[kids[-1]])
        w.put(b"<< %s >>" % body, numbers[k])
    roots = [k for k in range(len(items)) if of[k] is None]
    return w.put(b"<< /Type /Outlines /First %d 0 R /Last %d 0 R >>" % (numbers[roots[0]], numbers[roots[-1]]), top)


# Encoders, the other way round from the filters


def run_length_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        same = 1
        while same < 128 and at + same < len(data) and data[at + same] == data[at]:
            same += 1
        if same > 1:
            out += bytes([257 - same, data[at]])
            at += same
        else:
            end = at + 1
            while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
                end += 1
            out += bytes([end - at - 1]) + data[at:end]
            at = end
    return bytes(out + b"\x80")


def lzw_encode(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    width, size, bits, n, w = 9, 258, 0, 0, b""
    out = bytearray()

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> n - 8 & 255)
            n -= 8
        bits &= (1 << n) - 1

    put(256)
    for b in data:
        x = w + bytes([b])
        if x in table:
            w = x
            continue
        put(table[w])
        table[x] = size
        size += 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        w = bytes([b])
    if w:
        put(table[w])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def png_up(data: bytes, columns: int) -> bytes:
    """Rows of `columns` bytes (the last padded with spaces), each less the one above."""
    data += b" " * (-len(data) % columns)
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns):
        row = data[at : at + columns]
        out += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
        above = row
    return bytes(out)
