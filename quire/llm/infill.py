"""Fill-in-middle transformation over an index of distinct texts."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

from .common import column, long_rows, slices, small

MARKS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Rows with one text that are joined in one place.
HOT = 512
#: Words of 64 bits between two entries of a list's directory.
STEP = 64
_HEAD = struct.Struct("<qqqq")
CUT = ("n", "a", "b", "a_byte", "b_byte", "h3", "h4")


def encode(values: np.ndarray, universe: int) -> bytes:
    """An Elias-Fano list of growing numbers below `universe`: the lowest bits of each,
    packed, and the rest as set bits of one bit vector (number k stands at its high
    part plus k), with the count of set bits before every STEP words."""
    n = len(values)
    low = max(0, int(universe // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(((int(places[-1]) // 64 + 1) * 64) if n else 0, np.uint8)
    bits[places] = 1
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])[:-1:STEP] if n else np.zeros(0, np.int64)
    rest = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lower = np.packbits(rest.astype(np.uint8).reshape(-1), bitorder="little")
    return _HEAD.pack(n, universe, low, len(upper)) + before.astype("<i8").tobytes() + upper.tobytes() + lower.tobytes()


def size(packed: bytes) -> int:
    return _HEAD.unpack_from(packed)[0]


def select(packed: bytes, k: int) -> int:
    """Number k of an encoded list; for its length, the universe."""
    n, universe, low, words = _HEAD.unpack_from(packed)
    if not 0 <= k <= n:
        raise IndexError(f"{k} of a list of {n}")
    if k == n:
        return universe
    entries = -(-words // STEP)
    before = np.frombuffer(packed, "<i8", entries, _HEAD.size)
    block = int(np.searchsorted(before, k, side="right")) - 1
    at = _HEAD.size + 8 * entries
    part = np.frombuffer(packed, np.uint64, min(STEP, words - block * STEP), at + 8 * block * STEP)
    seen = int(before[block]) + np.cumsum(np.bitwise_count(part), dtype=np.int64)
    word = int(np.searchsorted(seen, k, side="right"))
    value, rest = int(part[word]), k - (int(seen[word - 1]) if word else int(before[block]))
    for _ in range(rest):
        value &= value - 1
    high = (block * STEP + word) * 64 + (value & -value).bit_length() - 1 - k
    first, end = k * low, (k + 1) * low
    own = packed[at + 8 * words + first // 8 : at + 8 * words + (end + 7) // 8]
    return high << low | int.from_bytes(own, "little") >> first % 8 & ((1 << low) - 1)


def boundaries(text: bytes) -> bytes:
    """The list of the byte offsets at which the code points of a UTF-8 text start."""
    own = np.frombuffer(text, np.uint8)
    return encode(np.flatnonzero((own & 0xC0) != 0x80), len(own))


def _places(docs: DataFrame, hot: int) -> DataFrame:
    """doc_id, text and key: equal texts have one key, or if over `hot` rows hold it, a key
    for about so many rows each."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    crowded = own.groupBy("h").count().where(F.col("count") > hot).select("h", F.ceil(F.col("count") / hot).cast("long").alias("parts"))
    crowded = small(materialize(crowded, "crowded").withColumnRenamed("h", "of"))
    part = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.monotonically_increasing_id()), F.col("parts"))
    key = F.when(F.col("parts").isNull(), F.col("h")).otherwise(F.xxhash64("h", part))
    return own.join(crowded, F.col("h") == F.col("of"), "left").select("doc_id", "text", key.alias("key"))


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 by seed and doc_id."""
    return struct.unpack_from(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest())


def _indexed(batches, seed: int):
    """Rows sorted by key and text. The list of a text is made at the first of its rows
    and kept for those that follow, which are compared with it byte for byte."""
    known, starts = None, b""
    for b in slices(batches):
        out = []
        for doc_id, text in zip(column(b, "doc_id"), b.column(1).cast(pa.binary()).to_pylist()):
            if text != known:
                known, starts = text, boundaries(text)
            n = size(starts)
            h1, h2, h3, h4 = draws(doc_id, seed)
            x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
            out.append((n, x, y, select(starts, x), select(starts, y), h3, h4))
        columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text", *CUT])


def cuts(docs: DataFrame, seed: int = 1, hot: int = HOT) -> DataFrame:
    """doc_id, text, n (code points), a and b (code points before the cuts), a_byte and
    b_byte (bytes before them), h3 and h4 (numbers drawn by seed and doc_id).

    The texts move once: documents are dealt and sorted by a hash of the text and the
    text itself. There rows with one text stand together, whatever else has its hash;
    its boundary list is made once and serves them all. A text on many rows is dealt
    to several places, and what is held is one batch and one list."""
    placed = _places(long_rows(docs), hot).repartition("key").sortWithinPartitions("key", "text")
    return placed.select("doc_id", "text").mapInArrow(lambda batches: _indexed(batches, seed), f"doc_id long, text string, {', '.join(f'{c} long' for c in CUT)}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    parts = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))).otherwise(F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))


def transform(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, hot: int = HOT) -> DataFrame:
    """doc_id, n (code points), form (plain, psm, spm), prefix_chars and middle_chars (null
    if plain), output (the transformed text), for every document.

    A null text is the empty one; empty texts, texts that hold a mark already and `plain`
    of 100 documents stay as they are. Rows with a null doc_id draw as if it were empty.
    Repeated rows give equal rows; equal texts share a boundary list, and their cuts
    differ by doc_id. Texts of any length are taken whole; extra columns are ignored; an
    empty table gives no rows. `hot` affects the work, not the result."""
    rows = cuts(docs, seed, hot)
    holds = F.lit(False)
    for m in MARKS:
        holds = holds | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | holds | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    raw, a, b = F.col("text").cast("binary"), F.col("a_byte"), F.col("b_byte")
    piece = lambda start, length: F.substring(raw, start.cast("int"), length.cast("int"))
    prefix, middle, suffix = piece(F.lit(1), a), piece(a + 1, b - a), piece(b + 1, F.octet_length("text"))
    p, s, m = (F.lit(x).cast("binary") for x in MARKS)
    made = F.when(F.col("form") == "plain", raw).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", "n", "form",
        F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"),
        made.cast("string").alias("output"),
    )


def digest(transformed: DataFrame) -> DataFrame:
    """Transformed rows with digests of the output, and of the text rebuilt from output
    and form, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    own = F.col("output")
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(own).alias("output_sha256"), sha(restored(own, F.col("form"))).alias("restored_sha256"))


#: The same in DuckDB.
SQL = f"""
with own as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
drawn as (select doc_id, t, n, {", ".join(f"cast('0x' || substr(d, {8 * k + 1}, 8) as bigint) as h{k + 1}" for k in range(4))} from own),
cut as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a::bigint end as prefix_chars, case when form <> 'plain' then (b - a)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from parts
"""
