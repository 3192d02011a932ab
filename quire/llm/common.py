"""Helpers that the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import lookup, small  # noqa: F401  (operators take them from here)
from quire.session import with_settings

WHITE = " \t\n\x0b\x0c\r"


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def in_fold(key: object, mod: int, fold: int) -> bool:
    """The same in Python; a null key is in no fold."""
    return key is not None and zlib.crc32(str(key).encode()) % mod == fold


#: Rows that scans decode and Python gets at a time, where the session has Spark's
#: own values: those are for short rows, and texts run to megabytes.
LONG_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "256")}


def long_rows(docs: DataFrame) -> DataFrame:
    """docs in a session of its own that handles rows in smaller batches, so that memory
    follows a few hundred texts and not thousands. The caller's session and its own
    settings stay."""
    return with_settings(docs, LONG_ROWS)


#: Rows and bytes of text that are turned into Python objects at a time.
SLICE, SLICE_BYTES = 500, 16 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut small, by rows and by bytes of their column `text`, so that long
    texts are not all copied at once. A row is never cut."""
    for b in batches:
        at = b.schema.get_field_index("text")
        if at < 0 or b.num_rows < 2:
            ends = None
        else:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < b.num_rows:
            n = rows
            if ends is not None:
                before = int(ends[k - 1]) if k else 0
                n = min(n, max(1, int(np.searchsorted(ends, before + size, side="right")) - k))
            yield b.slice(k, n)
            k += n


def free(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores after it as it takes to be none of `taken`."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(df: DataFrame) -> Column:
    """With the doc_id it tells rows of a table apart that hold different texts."""
    return F.xxhash64(df["text"])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id (null like any other) and text are not in gone
    (_id, _h: doc_id and text_hash), which is written. Repeated rows stay or go
    together. The texts stay where they are if gone is small."""
    gone = small(gone)
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (text_hash(docs) == gone["_h"])
    return docs.join(gone, same, "left_anti")


_held: dict = {}


def hold(owner: str, key: object, make: Callable):
    """A table that all tasks of a Python process share. A process holds the tables
    of one operator at a time: those of another are given up when this one asks."""
    if _held.get("owner") != owner:
        _held.clear()
        _held["owner"] = owner
    if key not in _held:
        _held[key] = make()
    return _held[key]


class Bounded(dict):
    """A cache that starts anew when it holds `limit` entries."""

    def __init__(self, limit: int, make: Callable):
        super().__init__()
        self.limit, self.make = limit, make

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(dict):
    """A cache of two generations, `limit` entries together at most: when the young
    one is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, limit: int, make: Callable):
        super().__init__()
        self.half, self.make, self.old = limit // 2, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
