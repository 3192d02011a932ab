"""PDF objects and the parser that reads them from bytes."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any, NamedTuple


class PdfError(ValueError):
    """Bytes that can't be read; kind names the row in parse_errors."""

    def __init__(self, kind: str, offset: int = 0, message: str = ""):
        super().__init__(message or kind)
        self.kind, self.offset = kind, offset


class Name(str):
    """A name, without its slash."""


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    """A dictionary and the undecoded bytes that follow it."""

    __slots__ = ("data", "dict")

    def __init__(self, entries: dict, data: bytes):
        self.dict, self.data = entries, data


#: Containers deeper than that are an error.
NESTING = 100

_GAP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
#: A gap and what comes after it: 1 name, 2 and 3 reference, 4 number, 5 dictionary,
#: 6 string, 7 hex string, 8 array, 9 to 11 keywords.
_VALUE = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
    rb"|([+-]?(?:\d+\.?\d*|\.\d+))|(<<)|(\()|(<)|(\[)|(true)|(false)|(null))"
)
#: A gap and a dictionary's end, or a key.
_KEY = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(?:(>>)|/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*))")
_OBJ = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj")
_SPECIAL = re.compile(rb"[()\\]")
_ESCAPES = {110: b"\n", 114: b"\r", 116: b"\t", 98: b"\b", 102: b"\x0c"}
_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")
_KEYWORDS = {9: True, 10: False, 11: None}
#: Names up to that many bytes are kept, as they come again in each document.
_SHORT = 32


def _unescaped(raw: bytes) -> Name:
    if b"#" in raw:
        raw = _HEX.sub(lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("utf-8", "surrogateescape") if raw.isascii() else raw.decode("latin-1"))


_kept = lru_cache(4096)(_unescaped)


def unescape_name(raw: bytes) -> Name:
    return _kept(raw) if len(raw) <= _SHORT else _unescaped(raw)


def hex_bytes(raw: bytes) -> bytes:
    digits = _NOT_HEX.sub(b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def literal_string(data: bytes, pos: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis stands at pos, and where it ends."""
    out, depth, at = [], 1, pos + 1
    while True:
        m = _SPECIAL.search(data, at)
        if m is None:
            raise PdfError("syntax", pos, "string without end")
        k = m.start()
        out.append(data[at:k])
        c, at = data[k], k + 1
        if c == 40:
            depth += 1
            out.append(b"(")
        elif c == 41:
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(b")")
        else:
            e = data[at : at + 1]
            at += 1
            if e in b"01234567" and e:
                digits = re.compile(rb"[0-7]{1,3}").match(data, at - 1)[0]
                out.append(bytes([int(digits, 8) & 255]))
                at += len(digits) - 1
            elif e == b"\r":
                at += data[at : at + 1] == b"\n"
            elif e != b"\n":
                out.append(_ESCAPES.get(e[0], e) if e else b"")


#: Numbers with a fraction beyond that, either side of 0, are read as that.
LARGEST = 1e15


def real(raw: bytes) -> float:
    return min(LARGEST, max(-LARGEST, float(raw)))


def reals(raw: list[bytes]) -> list[float]:
    values = list(map(float, raw))
    return values if max(values) <= LARGEST and min(values) >= -LARGEST else list(map(real, raw))


def int32(value: int) -> int | None:
    """value if 32 bits hold it."""
    return value if -(1 << 31) <= value < 1 << 31 else None


def number(raw: bytes) -> int | float:
    if b"." in raw:
        return real(raw)
    value = int(raw)
    if not -(1 << 63) <= value < 1 << 63:
        raise PdfError("syntax", 0, "number out of range")
    return value


class Parser:
    """Recursive descent over a buffer."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def skip(self) -> None:
        self.pos = _GAP.match(self.data, self.pos).end()

    def parse(self, depth: int = 0) -> Any:
        if depth > NESTING:
            raise PdfError("syntax", self.pos, "nesting too deep")
        data, m = self.data, _VALUE.match(self.data, self.pos)
        if m is None:
            self.skip()
            raise PdfError("syntax", self.pos, f"unexpected {data[self.pos : self.pos + 1]!r}")
        kind, self.pos = m.lastindex, m.end()
        if kind == 1:
            return unescape_name(m[1])
        if kind == 3:
            return Ref(int(m[2]), int(m[3]))
        if kind == 4:
            return number(m[4])
        if kind == 5:
            return self._dict(depth)
        if kind == 6:
            value, self.pos = literal_string(data, self.pos - 1)
            return value
        if kind == 7:
            end = data.find(b">", self.pos)
            if end < 0:
                raise PdfError("syntax", self.pos - 1, "hex string without end")
            value, self.pos = hex_bytes(data[self.pos : end]), end + 1
            return value
        if kind == 8:
            out = []
            while True:
                self.skip()
                if data[self.pos : self.pos + 1] == b"]":
                    self.pos += 1
                    return out
                out.append(self.parse(depth + 1))
        return _KEYWORDS[kind]

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        data = self.data
        while True:
            m = _KEY.match(data, self.pos)
            if m is None:
                self.skip()
                raise PdfError("syntax", self.pos, "a key must be a name")
            if m[1] is not None:
                self.pos = m.end()
                return out
            if depth >= NESTING:
                self.skip()
                raise PdfError("syntax", self.pos, "nesting too deep")
            self.pos = m.end()
            key = unescape_name(m[2])
            out.setdefault(key, self.parse(depth + 1))  # the first of equal keys counts

    def indirect(self) -> tuple[Ref, Any]:
        """`N G obj ...`, a stream's bytes included; endobj may be missing."""
        m = _OBJ.match(self.data, self.pos)
        if m is None:
            raise PdfError("syntax", self.pos, "no object here")
        self.pos = m.end()
        value = self.parse()
        if isinstance(value, dict):
            self.skip()
            if self.data.startswith(b"stream", self.pos):
                return Ref(int(m[1]), int(m[2])), self._stream(value)
        return Ref(int(m[1]), int(m[2])), value

    def _stream(self, entries: dict) -> Stream:
        data, at = self.data, self.pos + 6
        at += 2 if data.startswith(b"\r\n", at) else data[at : at + 1] in (b"\n", b"\r")
        length = entries.get("Length")
        if isinstance(length, int) and 0 <= length <= len(data) - at and not isinstance(length, bool):
            self.pos = at + length
            return Stream(entries, data[at : at + length])
        end = data.find(b"endstream", at)
        if end < 0:
            raise PdfError("syntax", at, "stream without end")
        self.pos = end
        return Stream(entries, data[at:end].rstrip(b"\x00\t\n\x0c\r "))
