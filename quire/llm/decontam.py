"""Benchmark decontamination: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

from .common import hold, long_rows, slices, text_hash, texts, without_rows

SEED_WORDS, RARE, MIN_SCORE = 3, 8, 0.5
#: Bytes of test items that are sent to executors at a time.
BLOCK_BYTES = 8 << 20
#: Words of passages, padded, that are aligned at a time.
CELLS = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


_MIX = (np.int64(-0x61C8864680B583EB), np.int64(-0x4B47D0C5A1A2B3D5))


@dataclass
class Index:
    """The items of a block: their words by number, and where each seed stands. A
    seed is a run of three words; all words of an item that has fewer are its one
    seed. Seeds go by 64-bit hashes of the numbers: an alignment, not the seed,
    decides, so equal hashes of different seeds do no harm."""

    vocabulary: dict[str, int]
    items: list[tuple[int, np.ndarray]]
    #: Lengths of the seeds that occur.
    sizes: tuple[int, ...] = ()
    #: Distinct seeds, sorted; of the k-th the entries from starts[k] to starts[k + 1].
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    #: Item and place in it of each entry, and whether the seed is too frequent to call
    #: for an alignment of that item by itself.
    item: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    common: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Index:
        vocabulary: dict[str, int] = {}
        items = []
        for item_id, text in rows:
            w = words(text or "")
            if item_id is not None and w:
                items.append((item_id, np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64)))
        out = cls(vocabulary, items)
        found = [cls.seeds(ids, min(SEED_WORDS, len(ids))) for _, ids in items]
        out.sizes = tuple(sorted({min(SEED_WORDS, len(ids)) for _, ids in items}))
        if items:
            key = np.concatenate(found)
            item = np.repeat(np.arange(len(items)), [len(x) for x in found])
            place = np.concatenate([np.arange(len(x)) for x in found])
            out._sort(key, item, place, np.zeros(len(key), bool))
        return out

    def _sort(self, key, item, place, common) -> None:
        order = np.lexsort((place, item, key))
        self.item, self.place, self.common = item[order], place[order], common[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.starts = np.append(first, len(order))

    @staticmethod
    def seeds(ids: np.ndarray, size: int) -> np.ndarray:
        """A key for each run of `size` numbers, -1 where one is unknown."""
        n = len(ids) - size + 1
        if n < 1:
            return np.empty(0, np.int64)
        key, known = np.full(n, size, np.int64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for k in range(size):
                part = ids[k : k + n]
                known &= part >= 0
                key = (key ^ (key >> np.int64(31))) * _MIX[0] + (part + 1) * _MIX[1]
        return np.where(known, key & np.int64((1 << 63) - 1), -1)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's word numbers (-1: in no item), and for each seed that it holds
        where, and its place in `keys`."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        where, which = [], []
        for size in self.sizes:
            found = self.seeds(ids, size)
            if len(found) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                hit = np.flatnonzero((found >= 0) & (self.keys[at] == found))
                where.append(hit)
                which.append(at[hit])
        none = np.empty(0, np.int64)
        return (ids, np.concatenate(where), np.concatenate(which)) if where else (ids, none, none)

    def mark_common(self, frequency: np.ndarray, rare: int) -> Index:
        """frequency: of each of `keys` the number of documents. Of each item the seeds
        found in more than `rare` times as many documents as the median of those that
        are found at all are common. They are not given up: what holds no other seed
        is aligned if its words can reach the score."""
        n = np.repeat(frequency, np.diff(self.starts))
        met = n > 0
        median = np.zeros(len(self.items))
        order = np.lexsort((n[met], self.item[met]))
        item, count = self.item[met][order], n[met][order]
        own, first, size = np.unique(item, return_index=True, return_counts=True)
        median[own] = (count[first + (size - 1) // 2] + count[first + size // 2]) / 2
        out = Index(self.vocabulary, self.items, self.sizes)
        key = np.repeat(self.keys, np.diff(self.starts))
        out._sort(key[met], self.item[met], self.place[met], (n > rare * median[self.item])[met])
        return out

    def can_reach(self, k: int, ordered: np.ndarray, min_score: float) -> bool:
        """Whether sorted words hold enough of the item's, in whatever order: an
        alignment's score is the share of matched words at most."""
        ids, n = np.unique(self.items[k][1], return_counts=True)
        held = np.searchsorted(ordered, ids, "right") - np.searchsorted(ordered, ids)
        return int(np.minimum(held, n).sum()) >= min_score * len(self.items[k][1])

    def windows(self, ids: np.ndarray, where: np.ndarray, which: np.ndarray, min_score: float = MIN_SCORE) -> list[tuple[int, int, int]]:
        """item, start and end of the passages worth aligning with it: around each
        seed as long as the item and a quarter of it more on both sides. Passages
        with common seeds only are left out if their words can't reach the score."""
        if not len(where):
            return []
        n = self.starts[which + 1] - self.starts[which]
        entry = np.repeat(self.starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[entry]
        size = np.array([len(x) for _, x in self.items])[item] if len(item) > len(self.items) else np.array([len(self.items[k][1]) for k in item.tolist()], np.int64)
        begin = np.repeat(where, n) - self.place[entry]
        low, high = np.maximum(begin - size // 4 - 2, 0), np.minimum(begin + size + size // 4 + 2, len(ids))
        ranges = defaultdict(list)
        for k, *span in zip(item.tolist(), low.tolist(), high.tolist(), (~self.common[entry]).tolist()):
            ranges[k].append(tuple(span))
        out = []
        ordered = np.sort(ids) if ranges else ids
        for k, spans in ranges.items():
            if not any(sure for *_, sure in spans) and not self.can_reach(k, ordered, min_score):
                continue
            longest = 3 * len(self.items[k][1]) + 8
            own: list[list] = []
            for a, b, sure in sorted(set(spans)):
                if own and a <= own[-1][1] and b - own[-1][0] <= longest:
                    own[-1][1:] = max(own[-1][1], b), own[-1][2] or sure
                else:
                    own.append([a, b, sure])
            out += [(k, a, b) for a, b, sure in own if sure or self.can_reach(k, np.sort(ids[a:b]), min_score)]
        return out


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words, many pairs at a time: the best local score as a
    share of a full match of the item, and the place in the passage where it ends."""
    if not items:
        return np.empty(0), np.empty(0, np.int64)
    n, m = max(map(len, items)), max(map(len, passages))
    a, b = np.full((len(items), n), -2, np.int64), np.full((len(items), m), -3, np.int64)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    slope = np.arange(m + 1) * -GAP
    row, best, end = np.zeros((len(items), m + 1), np.int64), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    every = np.arange(len(items))
    for i in range(n):
        now = np.zeros_like(row)
        now[:, 1:] = np.maximum(row[:, :-1] + np.where(a[:, i, None] == b, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        at = now.argmax(axis=1)
        better = now[every, at] > best
        best, end = np.where(better, now[every, at], best), np.where(better, at, end)
        row = now
    return best / (MATCH * np.array([len(x) for x in items])), end


def _frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many rows each of the index's seeds is found. A task adds up its own, so
    no more numbers are shuffled than a task has seeds, and the driver gets one for
    each seed of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        hold("decontam", "", dict)
        x = shared.value
        total = np.zeros(len(x.keys), np.int64)
        for b in slices(batches):
            for t in texts(b):
                total[np.unique(x.read(t)[2])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["key", "n"])

    got = long_rows(docs).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(index.keys), np.int64)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def _matches(docs: DataFrame, index: Index, min_score: float) -> DataFrame:
    """doc_id, h (hash of the text), item_id, score, end_word."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        hold("decontam", "", dict)
        x = shared.value
        for b in slices(batches):
            rows: dict[tuple, tuple] = {}
            pairs: list = []
            widest = 0

            def settle():
                scores, ends = align([x.items[k][1] for _, k, _, _ in pairs], [w for *_, w in pairs])
                for (row, k, start, _), s, e in zip(pairs, scores.tolist(), ends.tolist()):
                    if s >= min_score and s > rows.get((row, k), (0,))[0]:
                        rows[row, k] = s, start + e
                pairs.clear()

            for row, t in enumerate(texts(b)):
                ids, where, which = x.read(t)
                for k, start, end in x.windows(ids, where, which, min_score):
                    widest = max(widest, end - start, len(x.items[k][1]))
                    if pairs and (len(pairs) + 1) * widest > CELLS:
                        settle()
                        widest = max(end - start, len(x.items[k][1]))
                    pairs.append((row, k, start, ids[start:end]))
            settle()
            at = pa.array([row for row, _ in rows], pa.int64())
            got = [pa.array([x.items[k][0] for _, k in rows], pa.int64()), pa.array([s for s, _ in rows.values()], pa.float64()), pa.array([e for _, e in rows.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *got], ["doc_id", "h", "item_id", "score", "end_word"])

    docs = long_rows(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("h"), "text")
    return own.mapInArrow(run, "doc_id long, h long, item_id long, score double, end_word long")


def _found(docs: DataFrame, benchmark: DataFrame, min_score: float, rare: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block))
    parts = []
    for k in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        index = Index.of(sorted((r["item_id"], r["text"]) for r in own))
        if index.items:
            parts.append(_matches(docs, index.mark_common(_frequencies(docs, index), rare), min_score))
    if not parts:
        return spark.createDataFrame([], "doc_id long, h long, item_id long, score double, end_word long")
    return reduce(DataFrame.unionAll, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, rare: int = RARE, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, end_word: each document row with each test item that
    it holds a copy of, whole or edited; the best alignment's score as a share of
    a full match, and the number of words before its end (of equal scores the first
    passage's).

    Test items are taken in blocks of about `block` bytes of text (their size is
    counted first), so what is sent to executors has a bound; a block costs two passes
    over the documents, one that counts its seeds and one that aligns. A copy is found
    if it keeps three words of the item in a row; items of one or two words are found
    where these stand together. Items without a word or with
    a null id, and null or empty texts, match nothing; empty tables give no rows.
    Texts and items of any length are taken whole: alignments are batched by their
    cells. A repeated row gives its results again, with its doc_id (null if that is
    null); items with equal texts are each reported. Extra columns are ignored."""
    return _found(docs, benchmark, min_score, rare, block).drop("h")


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, rare: int = RARE, block: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text holds no test item, all their columns unchanged.
    Each row is judged by its own text, whether its doc_id is null or repeated."""
    gone = _found(docs, benchmark, min_score, rare, block).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    return without_rows(long_rows(docs), materialize(gone, "leaks"))
