"""Stream filters. Each takes bytes and its parameters and gives bytes."""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np

from .objects import PdfError, hex_bytes

#: No stream inflates to more bytes than that.
LIMIT = 256 << 20
#: No more filters in a chain than that.
CHAIN = 16

_WHITE = re.compile(rb"[\x00\t\n\x0b\x0c\r ]+")


def flate(data: bytes, params: dict) -> bytes:
    """A damaged or cut tail keeps what was inflated before it, if anything was."""
    machine, out, size = zlib.decompressobj(), [], 0
    try:
        while data:
            piece = machine.decompress(data, LIMIT - size + 1)
            size += len(piece)
            if size > LIMIT:
                raise PdfError("decompress", 0, "stream inflates beyond the limit")
            out.append(piece)
            data = machine.unconsumed_tail
        out.append(machine.flush())
    except zlib.error as e:
        if not size:
            raise PdfError("decompress", 0, str(e)) from e
    return predict(b"".join(out), params)


def lzw(data: bytes, params: dict) -> bytes:
    early = params.get("EarlyChange", 1)
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, last, size = [], 9, 0, 0, None, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if last is None:
            entry = table[code] if code < 256 else b""
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise PdfError("decompress", 0, "LZW code out of range")
        out.append(entry)
        size += len(entry)
        if size > LIMIT:
            raise PdfError("decompress", 0, "stream inflates beyond the limit")
        last = entry
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return predict(b"".join(out), params)


def ascii85(data: bytes, params: dict) -> bytes:
    data = _WHITE.sub(b"", data)
    data = data.removeprefix(b"<~")
    end = data.find(b"~")
    data = data if end < 0 else data[:end]
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (_base85(group) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise PdfError("decompress", 0, "byte outside base 85")
    if len(group) > 1:
        out += (_base85(group + [84] * (5 - len(group))) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    value = 0
    for d in digits:
        value = value * 85 + d
    return value


def ascii_hex(data: bytes, params: dict) -> bytes:
    end = data.find(b">")
    return hex_bytes(data if end < 0 else data[:end])


def run_length(data: bytes, params: dict) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        if len(out) > LIMIT:
            raise PdfError("decompress", 0, "stream grows beyond the limit")
    return bytes(out)


def predict(data: bytes, params: dict) -> bytes:
    kind = params.get("Predictor", 1)
    if kind == 1:
        return data
    colors, depth, columns = params.get("Colors", 1), params.get("BitsPerComponent", 8), params.get("Columns", 1)
    pixel, row = max(1, colors * depth // 8), (columns * colors * depth + 7) // 8
    if row <= 0:
        raise PdfError("decompress", 0, "predictor without columns")
    if kind == 2:
        if depth != 8:
            return data
        whole = len(data) // row * row
        a = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        return np.add.accumulate(a, axis=1, dtype=np.uint8).tobytes() + data[whole:]
    if not 10 <= kind <= 15:
        raise PdfError("decompress", 0, "unknown predictor")
    return _png(data, row, pixel)


def _png(data: bytes, row: int, pixel: int) -> bytes:
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        n = len(line)
        if tag == 1:
            for i in range(pixel, n):
                line[i] = (line[i] + line[i - pixel]) & 255
        elif tag == 2:
            line = bytearray(((np.frombuffer(line, np.uint8).astype(np.uint16) + np.frombuffer(above[:n], np.uint8)) & 255).astype(np.uint8).tobytes())
        elif tag == 3:
            for i in range(n):
                line[i] = (line[i] + ((line[i - pixel] if i >= pixel else 0) + above[i] >> 1)) & 255
        elif tag == 4:
            for i in range(n):
                a, b, c = (line[i - pixel], above[i], above[i - pixel]) if i >= pixel else (0, above[i], 0)
                line[i] = (line[i] + paeth(a, b, c)) & 255
        out += line
        above = line + bytearray(row - n)
    return bytes(out)


def paeth(left: int, up: int, corner: int) -> int:
    """Whichever neighbour is nearest to left + up - corner."""
    guess = left + up - corner
    return min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]


def _image(data: bytes, params: dict) -> bytes:
    return data


FILTERS = {
    "FlateDecode": flate, "Fl": flate, "LZWDecode": lzw, "LZW": lzw, "ASCII85Decode": ascii85, "A85": ascii85,
    "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length,
    "DCTDecode": _image, "DCT": _image, "CCITTFaxDecode": _image, "CCF": _image, "JBIG2Decode": _image, "JPXDecode": _image,
}


def decode(data: bytes, filters: Any, params: Any) -> bytes:
    """Run a stream's filter or chain of filters. A params dictionary holds for
    each filter, an array goes by place."""
    if filters is None:
        return data
    chain = filters if isinstance(filters, list) else [filters]
    if len(chain) > CHAIN:
        raise PdfError("decompress", 0, "too many filters")
    for k, name in enumerate(chain):
        own = params[k] if isinstance(params, list) and k < len(params) else params
        step = FILTERS.get(name) if isinstance(name, str) else None
        if step is None:
            raise PdfError("decompress", 0, f"unsupported filter {name}")
        data = step(data, own if isinstance(own, dict) else {})
    return data
