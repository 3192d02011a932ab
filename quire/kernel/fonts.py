"""Fonts: from the codes of a shown string to text."""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import accumulate
from typing import Any

from .objects import Name, Ref, Stream, hex_bytes

# Encodings

#: The upper half of Adobe's standard encoding, code to glyph name.
STANDARD_UPPER = {
    161: "exclamdown", 162: "cent", 163: "sterling", 164: "fraction", 165: "yen", 166: "florin", 167: "section", 168: "currency",
    169: "quotesingle", 170: "quotedblleft", 171: "guillemotleft", 172: "guilsinglleft", 173: "guilsinglright", 174: "fi", 175: "fl",
    177: "endash", 178: "dagger", 179: "daggerdbl", 180: "periodcentered", 182: "paragraph", 183: "bullet", 184: "quotesinglbase",
    185: "quotedblbase", 186: "quotedblright", 187: "guillemotright", 188: "ellipsis", 189: "perthousand", 191: "questiondown",
    193: "grave", 194: "acute", 195: "circumflex", 196: "tilde", 197: "macron", 198: "breve", 199: "dotaccent", 200: "dieresis",
    202: "ring", 203: "cedilla", 205: "hungarumlaut", 206: "ogonek", 207: "caron", 208: "emdash", 225: "AE", 227: "ordfeminine",
    232: "Lslash", 233: "Oslash", 234: "OE", 235: "ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash", 249: "oslash", 250: "oe",
    251: "germandbls",
}

#: PDFDocEncoding where it differs from Latin-1.
PDFDOC = {
    24: 0x2D8, 25: 0x2C7, 26: 0x2C6, 27: 0x2D9, 28: 0x2DD, 29: 0x2DB, 30: 0x2DA, 31: 0x2DC, 128: 0x2022, 129: 0x2020, 130: 0x2021,
    131: 0x2026, 132: 0x2014, 133: 0x2013, 134: 0x192, 135: 0x2044, 136: 0x2039, 137: 0x203A, 138: 0x2212, 139: 0x2030, 140: 0x201E,
    141: 0x201C, 142: 0x201D, 143: 0x2018, 144: 0x2019, 145: 0x201A, 146: 0x2122, 147: 0xFB01, 148: 0xFB02, 149: 0x141, 150: 0x152,
    151: 0x160, 152: 0x178, 153: 0x17D, 154: 0x131, 155: 0x142, 156: 0x153, 157: 0x161, 158: 0x17E, 160: 0x20AC,
}

#: Names of glyphs that no rule below gives.
GLYPHS = {
    "space": 0x20, "exclam": 0x21, "quotedbl": 0x22, "numbersign": 0x23, "dollar": 0x24, "percent": 0x25, "ampersand": 0x26,
    "quotesingle": 0x27, "quoteright": 0x2019, "quoteleft": 0x2018, "parenleft": 0x28, "parenright": 0x29, "asterisk": 0x2A, "plus": 0x2B,
    "comma": 0x2C, "hyphen": 0x2D, "minus": 0x2212, "period": 0x2E, "slash": 0x2F, "zero": 0x30, "one": 0x31, "two": 0x32, "three": 0x33,
    "four": 0x34, "five": 0x35, "six": 0x36, "seven": 0x37, "eight": 0x38, "nine": 0x39, "colon": 0x3A, "semicolon": 0x3B, "less": 0x3C,
    "equal": 0x3D, "greater": 0x3E, "question": 0x3F, "at": 0x40, "bracketleft": 0x5B, "backslash": 0x5C, "bracketright": 0x5D,
    "asciicircum": 0x5E, "underscore": 0x5F, "grave": 0x60, "braceleft": 0x7B, "bar": 0x7C, "braceright": 0x7D, "asciitilde": 0x7E,
    "exclamdown": 0xA1, "cent": 0xA2, "sterling": 0xA3, "fraction": 0x2044, "yen": 0xA5, "florin": 0x192, "section": 0xA7, "currency": 0xA4,
    "brokenbar": 0xA6, "copyright": 0xA9, "logicalnot": 0xAC, "registered": 0xAE, "degree": 0xB0, "plusminus": 0xB1, "mu": 0xB5,
    "onesuperior": 0xB9, "twosuperior": 0xB2, "threesuperior": 0xB3, "onequarter": 0xBC, "onehalf": 0xBD, "threequarters": 0xBE,
    "multiply": 0xD7, "divide": 0xF7, "quotedblleft": 0x201C, "quotedblright": 0x201D, "guillemotleft": 0xAB, "guillemotright": 0xBB,
    "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "fi": 0xFB01, "fl": 0xFB02, "ff": 0xFB00, "ffi": 0xFB03, "ffl": 0xFB04,
    "endash": 0x2013, "emdash": 0x2014, "dagger": 0x2020, "daggerdbl": 0x2021, "periodcentered": 0xB7, "paragraph": 0xB6,
    "bullet": 0x2022, "quotesinglbase": 0x201A, "quotedblbase": 0x201E, "ellipsis": 0x2026, "perthousand": 0x2030, "questiondown": 0xBF,
    "acute": 0xB4, "circumflex": 0x2C6, "tilde": 0x2DC, "macron": 0xAF, "breve": 0x2D8, "dotaccent": 0x2D9, "dieresis": 0xA8, "ring": 0x2DA,
    "cedilla": 0xB8, "hungarumlaut": 0x2DD, "ogonek": 0x2DB, "caron": 0x2C7, "AE": 0xC6, "ae": 0xE6, "OE": 0x152, "oe": 0x153,
    "Lslash": 0x141, "lslash": 0x142, "Oslash": 0xD8, "oslash": 0xF8, "ordfeminine": 0xAA, "ordmasculine": 0xBA, "dotlessi": 0x131,
    "germandbls": 0xDF, "Eth": 0xD0, "eth": 0xF0, "Thorn": 0xDE, "thorn": 0xFE, "trademark": 0x2122, "Euro": 0x20AC, "nbspace": 0xA0, "florint": 0x192,
}

#: Marks that a glyph name adds to a letter, and their combining characters.
MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "hungarumlaut": "̋"}

_UNI = re.compile(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{5,6})")


@cache
def glyph(name: str) -> int | None:
    """The code point of a glyph name: a listed name, a single letter, a letter and
    a mark, uniXXXX or uXXXXX."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1 and name.isascii() and name.isalpha():
        return ord(name)
    if m := _UNI.match(name):
        value = int(m[1] or m[2], 16)
        return value if value <= 0x10FFFF and not 0xD800 <= value < 0xE000 else None
    if name[:1].isascii() and name[1:] in MARKS:
        both = unicodedata.normalize("NFC", name[0] + MARKS[name[1:]])
        return ord(both) if len(both) == 1 else None
    return None


def _codec(name: str) -> list[int]:
    out = []
    for b in range(256):
        try:
            out.append(ord(bytes([b]).decode(name)))
        except UnicodeDecodeError:
            out.append(0)
    return out


@cache
def named_encoding(name: str) -> tuple[int, ...] | None:
    """256 code points (0: none) of an encoding that PDF names."""
    if name == "WinAnsiEncoding":
        return tuple(_codec("cp1252"))
    if name == "MacRomanEncoding":
        return tuple(_codec("mac_roman"))
    if name == "StandardEncoding":
        table = [c if 32 <= c < 127 else 0 for c in range(256)]
        table[39], table[96] = 0x2019, 0x2018
        for code, g in STANDARD_UPPER.items():
            table[code] = glyph(g)
        return tuple(table)
    if name == "PDFDocEncoding":
        return tuple(PDFDOC.get(c, c) for c in range(256))
    return None


#: What a string without a font shows: cp1252, unmapped bytes and NUL left out.
FALLBACK = {c: (chr(u) if u else None) for c, u in enumerate(named_encoding("WinAnsiEncoding"))}


def decode_without_font(data: bytes) -> str:
    return data.decode("latin-1").translate(FALLBACK)


@lru_cache(64)
def _characters(table: tuple[int, ...]) -> dict[int, str]:
    """What a font's codes show. Fonts with one table share it."""
    return {c: chr(u) if u else " " for c, u in enumerate(table)}


@dataclass
class Font:
    name: str = ""
    subtype: str | None = None
    table: list[int] = field(default_factory=lambda: list(named_encoding("WinAnsiEncoding")))
    is_cid: bool = False
    bytes_per_char: int = 1
    wmode: int = 0
    single: dict[int, int] = field(default_factory=dict)
    multi: dict[int, str] = field(default_factory=dict)
    ranges: list[tuple[int, int, int]] = field(default_factory=list)
    glyph_names: list[str] | None = None
    ascender: float = 800.0
    descender: float = -200.0
    cap_height: float = 700.0
    x_height: float = 500.0
    italic_angle: float = 0.0
    missing_width: float = 600.0
    widths: dict[int, float] = field(default_factory=dict)
    cid_widths: list[tuple[int, int, float]] = field(default_factory=list)
    default_width: float = 1000.0
    ordering: str | None = None
    gids: bytes | None = None
    _map: dict | None = None
    _reach: list[int] = field(default_factory=list)
    _codes: dict[int, str] = field(default_factory=dict)

    def decode(self, data: bytes) -> str:
        if self.is_cid:
            return self._decode_cid(data)
        if self._map is None:
            plain = _characters(tuple(self.table))
            self._map = plain | {c: t for c, t in self.multi.items() if t and c < len(self.table)} if self.multi else plain
        return data.decode("latin-1").translate(self._map)

    def _decode_cid(self, data: bytes) -> str:
        n, known, out, at = self.bytes_per_char, self._codes, [], 0
        if n == 1:
            return "".join([known.get(b) or self._code(b, 1) for b in data])
        if n == 2 and not len(data) & 1:
            found = [known.get(c) for c in struct.unpack(f">{len(data) // 2}H", data)]
            if None not in found:
                return "".join(found)
        while at < len(data):
            took = n if at + n <= len(data) else 1
            code = int.from_bytes(data[at : at + took], "big")
            at += took
            text = known.get(code) if took == n else None
            if text is None:
                if took == 2 and 0xD800 <= code < 0xDC00 and self._mapped(code) is None:
                    low = int.from_bytes(data[at : at + 2], "big") if at + 2 <= len(data) else 0
                    if 0xDC00 <= low < 0xE000:
                        at += 2
                        out.append(chr(0x10000 + ((code - 0xD800) << 10) + low - 0xDC00))
                    else:
                        out.append("�")
                    continue
                text = self._code(code, took)
            out.append(text)
        return "".join(out)

    def _mapped(self, code: int) -> str | int | None:
        if code in self.multi:
            return self.multi[code]
        if code in self.single:
            return self.single[code]
        if self.ranges:
            # the last range that starts at the code or before; then those before it, as
            # ranges may overlap, until none can reach the code
            at = bisect_right(self.ranges, (code, 1 << 62, 0)) - 1
            while at >= 0 and self._reach[at] >= code:
                first, last, to = self.ranges[at]
                if code <= last:
                    return to + code - first
                at -= 1
        if self.glyph_names is not None and code & 0xFFFF < len(self.glyph_names):
            return glyph(self.glyph_names[code & 0xFFFF] or ".notdef")
        return None

    def _code(self, code: int, took: int) -> str:
        value = self._mapped(code)
        if value is None:
            value = code
        if not isinstance(value, str):
            value = " " if not value or value > 0x10FFFF else "�" if 0xD800 <= value < 0xE000 else chr(value)
        if took == self.bytes_per_char:
            self._codes[code] = value
        return value

    def width(self, code: int) -> float:
        """Of a code, in thousandths of the size; of a CID, the first range counts."""
        if not self.is_cid:
            return self.widths.get(code, self.missing_width)
        return next((w for a, b, w in self.cid_widths if a <= code <= b), self.default_width)

    def width_ranges(self) -> list[tuple[int, int, float]]:
        """First and last code and the width of each range; of overlapping ones the first
        counts."""
        return list(self.cid_widths) if self.is_cid else [(c, c, w) for c, w in sorted(self.widths.items())]

    def gid(self, cid: int) -> int:
        """The glyph index of a CID; the CID itself without a map."""
        if self.gids is None or 2 * cid + 2 > len(self.gids):
            return cid
        return int.from_bytes(self.gids[2 * cid : 2 * cid + 2], "big")


# Reading fonts

_TOKEN = re.compile(rb"<([^>]*)>|(\[)|(\])|(\S+?)(?=[\s<\[\]]|$)")
_WMODE = re.compile(rb"/WMode\s+(\d+)")


def _units(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


def read_cmap(data: bytes, font: Font) -> None:
    """bfchar and bfrange entries, and the writing mode."""
    if m := _WMODE.search(data):
        font.wmode = int(m[1])
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", data, re.S):
        tokens = [(hex_bytes(m[1]) if m[0].startswith(b"<") else m[0]) for m in _TOKEN.finditer(body)]
        at = 0
        if kind == b"bfchar":
            for code, to in zip(tokens[::2], tokens[1::2]):
                _put(font, int.from_bytes(code, "big"), to)
            continue
        while at + 2 < len(tokens):
            first, last, to = int.from_bytes(tokens[at], "big"), int.from_bytes(tokens[at + 1], "big"), tokens[at + 2]
            at += 3
            if to == b"[":
                code = first
                while at < len(tokens) and tokens[at] != b"]":
                    if code <= last:
                        _put(font, code, tokens[at])
                    code, at = code + 1, at + 1
                at += 1
            elif len(to) <= 2:
                font.ranges.append((first, last, int.from_bytes(to, "big")))
            else:
                text = _units(to)
                for code in range(first, min(last, first + 0xFFFF) + 1):
                    font.multi[code] = text[:-1] + chr(min(0x10FFFF, ord(text[-1]) + code - first))
    font.ranges.sort()
    font._reach = list(accumulate((last for _, last, _ in font.ranges), max))
    if font.single or font.multi or font.ranges:
        font.is_cid = True


def _put(font: Font, code: int, to: bytes) -> None:
    if len(to) <= 2:
        font.single[code] = int.from_bytes(to, "big")
    else:
        font.multi[code] = _units(to)


def read_font(doc: Any, entries: dict, name: str = "") -> Font:
    """doc gives resolve(), get() and stream_data()."""
    font = Font(name, doc.get(entries, "Subtype", Name))
    composite, inner = font.subtype == "Type0", None
    if composite:
        font.is_cid, font.bytes_per_char = True, 2
        encoding = doc.resolve(entries.get("Encoding"))
        if isinstance(encoding, Name):
            font.wmode = int(encoding.endswith("-V"))
        elif isinstance(encoding, Stream):
            _cmap(doc, encoding, font)
        inner = doc.resolve((doc.get(entries, "DescendantFonts", list) or [None])[0])
        if isinstance(inner, dict):
            system = doc.get(inner, "CIDSystemInfo", dict) or {}
            ordering = doc.get(system, "Ordering", bytes)
            font.ordering = ordering.decode("latin-1") if ordering else None
            gids = doc.resolve(inner.get("CIDToGIDMap"))
            if doc.get(inner, "Subtype", Name) == "CIDFontType2" and isinstance(gids, Stream):
                font.gids = _bytes(doc, gids)
            if not (font.single or font.multi or font.ranges) and isinstance(s := doc.resolve(inner.get("ToUnicode")), Stream):
                _cmap(doc, s, font)
    unicode = doc.resolve(entries.get("ToUnicode"))
    if isinstance(unicode, Stream):
        _cmap(doc, unicode, font)
    elif not composite:
        encoding = doc.resolve(entries.get("Encoding"))
        if isinstance(encoding, Name):
            font.table = list(named_encoding(encoding) or font.table)
        elif isinstance(encoding, dict):
            font.table = list(named_encoding(doc.get(encoding, "BaseEncoding", Name) or "") or font.table)
            _differences(doc, doc.get(encoding, "Differences", list) or [], font)
        if font.subtype in ("CIDFontType0", "CIDFontType2"):
            font.is_cid, font.bytes_per_char = True, 2
    for source in (entries, inner):
        if isinstance(source, dict):
            _descriptor(doc, source, font)
            _widths(doc, source, font)
    return font


def _bytes(doc: Any, s: Stream) -> bytes:
    try:
        return doc.stream_data(s)
    except (ValueError, MemoryError):
        return b""


def _cmap(doc: Any, s: Stream, font: Font) -> None:
    try:
        read_cmap(_bytes(doc, s), font)
    except (ValueError, IndexError, TypeError):
        pass


def _differences(doc: Any, items: list, font: Font) -> None:
    code = 0
    for item in items:
        item = doc.resolve(item)
        if isinstance(item, Name):
            if 0 <= code < 256:
                font.table[code] = glyph(item) or 0
            code += 1
        elif isinstance(item, int):
            code = item


def _number(doc: Any, entries: dict, key: str, default: float) -> float:
    value = doc.get(entries, key, (int, float))
    return default if value is None else float(value)


def _descriptor(doc: Any, entries: dict, font: Font) -> None:
    d = doc.get(entries, "FontDescriptor", dict)
    if d is None:
        return
    for key in ("Ascent", "Descent", "CapHeight", "XHeight", "ItalicAngle", "MissingWidth"):
        attr = {"Ascent": "ascender", "Descent": "descender", "CapHeight": "cap_height", "XHeight": "x_height", "ItalicAngle": "italic_angle", "MissingWidth": "missing_width"}[key]
        setattr(font, attr, _number(doc, d, key, getattr(font, attr)))
    program = doc.resolve(d.get("FontFile3"))
    if isinstance(program, Stream) and doc.get(program.dict, "Subtype", Name) in ("Type1C", "CIDFontType0C"):
        from .cff import glyph_names

        font.glyph_names = glyph_names(_bytes(doc, program))


def _widths(doc: Any, entries: dict, font: Font) -> None:
    first, widths = doc.get(entries, "FirstChar", int) or 0, doc.get(entries, "Widths", list) or []
    font.widths.update({first + k: float(w) for k, v in enumerate(widths) if isinstance(w := doc.resolve(v), (int, float))})
    font.default_width = _number(doc, entries, "DW", font.default_width)
    items, at = [doc.resolve(v) for v in doc.get(entries, "W", list) or []], 0
    while at + 1 < len(items):
        a, b = items[at], items[at + 1]
        if isinstance(b, list):
            font.cid_widths += [(a + k, a + k, float(w)) for k, w in enumerate(map(doc.resolve, b)) if isinstance(w, (int, float))]
            at += 2
        elif at + 2 < len(items) and isinstance(items[at + 2], (int, float)):
            font.cid_widths.append((a, b, float(items[at + 2])))
            at += 3
        else:
            break


def page_fonts(doc: Any, resources: dict, shared: dict[Any, Font]) -> dict[str, Font]:
    """The fonts of a page by name; `shared` keeps those that several pages use."""
    out: dict[str, Font] = {}
    for name, value in (doc.get(resources, "Font", dict) or {}).items():
        key = value if isinstance(value, Ref) else id(value)
        if key not in shared:
            entries = doc.resolve(value)
            if not isinstance(entries, dict):
                continue
            shared[key] = read_font(doc, entries, name)
        out[name] = shared[key]
    return out
