"""Which of some pairs of texts resemble each other: candidates from cells, and the
exact similarity of their shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

from .common import hold, long_rows, slices, small, text_hash, texts
from .simhash import shingles

WORDS, SIMILARITY = 5, 0.8
#: Spanning trees of a cell whose links are looked at; more bits than can differ.
TREES, FAR = 3, 200


def parity(own: np.ndarray, wide: int = 1) -> bytes:
    """Bits by the number of members with the same low bits of the hash, odd or even;
    a power of two of them, at least `wide` for each member. Sets differ in as many
    members at least as their parities do in bits."""
    bits = max(64, 1 << (wide * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def can_reach(n: int, x: bytes, m: int, y: bytes, similarity: float) -> bool:
    """Whether sizes and parities of two sets allow the similarity."""
    if min(n, m) < similarity * max(n, m) - 1e-6:
        return False
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def forest(cell: np.ndarray, name: np.ndarray, fp: np.ndarray, low: np.ndarray, most: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell. u, v: of each cell the links of `trees` spanning trees over
    its members that share no link and take the fewest differing bits, without links
    of over `most` bits. No more than `trees` links a member, and each member with
    those most like it."""
    fp, low = fp.view(np.uint64), low.view(np.uint64)
    differ = lambda x, y: np.bitwise_count(fp[x] ^ fp[y]).astype(np.int16) + np.bitwise_count(low[x] ^ low[y])
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(starts, len(cell)))
    two = starts[size == 2]
    two = two[(name[two] != name[two + 1]) & (differ(two, two + 1) <= most)]
    u, v = [name[two]], [name[two + 1]]
    for a, m in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
        used = np.zeros((m, m), bool)
        rows = slice(a, a + m)
        for _ in range(min(trees, m - 1)):
            near, by, left, right = np.full(m, FAR, np.int16), np.zeros(m, np.int64), [], []
            near[0] = 0
            for _ in range(m):
                k = int(near.argmin())
                if near[k] <= most and (k or left) and name[a + k] != name[a + by[k]]:
                    left.append(k)
                    right.append(int(by[k]))
                d = differ(rows, a + k)
                d[used[k]] = FAR
                closer = (d < near) & (near <= FAR)
                near[closer], by[closer] = d[closer], k
                near[k] = FAR + 1
            u.append(name[a + np.array(left, np.int64)])
            v.append(name[a + np.array(right, np.int64)])
            used[left, right] = used[right, left] = True
    return np.concatenate(u), np.concatenate(v)


def similar(docs: DataFrame, seen: DataFrame, sets: DataFrame, pairs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Of the pairs (u, v) of sets, in any order and repeated, those that have the
    similarity, written. What sizes and parities can't rule out is decided by the
    whole sets, which are made again from a text of each."""
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "pairs")

    def asked(pairs):
        both = pairs.select(F.col("u").alias("set")).unionAll(pairs.select(F.col("v").alias("set"))).distinct()
        rows = small(materialize(sets.select("set", "row").join(small(materialize(both, "asked")), "set", "left_semi").select("row"), "rows"))
        return seen.join(rows, "row", "left_semi")

    def possible(batches):
        for part in slices(batches):
            can = [can_reach(n, x, m, y, similarity) for n, x, m, y in zip(*(part.column(k).to_pylist() for k in range(2, 6)))]
            yield part.select([0, 1]).filter(pa.array(can, pa.bool_()))

    def decide(batches):
        for part in slices(batches, 50):
            near = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared / (len(x) + len(y) - shared) >= similarity)
            yield part.select([0, 1]).filter(pa.array(near, pa.bool_()))

    def whole(batches):
        hold("resemblance", "", dict)
        for b in slices(batches, 200):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, words)).tobytes() for t in texts(b)], pa.binary())], ["set", "shingles"])

    odd = asked(pairs)
    a, b = odd.select(F.col("set").alias("u"), F.col("n").alias("n"), F.col("parity").alias("x")), odd.select(F.col("set").alias("v"), F.col("n").alias("m"), F.col("parity").alias("y"))
    both = a.join(small(pairs), "u").join(b.hint("merge"), "v").select("u", "v", "n", "x", "m", "y")
    pairs = materialize(both.mapInArrow(possible, "u long, v long"), "possible")
    wanted = small(materialize(asked(pairs).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("set").alias("_set")), "wanted"))
    own = long_rows(docs).select("doc_id", "text")
    same = own["doc_id"].cast("long").eqNullSafe(wanted["_id"]) & (text_hash(own) == wanted["_h"])
    held = own.join(wanted, same).select(wanted["_set"].alias("set"), own["text"].alias("text"))
    held = materialize(held.mapInArrow(whole, "set long, shingles binary").dropDuplicates(["set"]), "held")
    a, b = held.select(F.col("set").alias("u"), F.col("shingles").alias("x")), held.select(F.col("set").alias("v"), F.col("shingles").alias("y"))
    both = a.join(small(pairs), "u").join(b.hint("merge"), "v").select("u", "v", "x", "y")
    return materialize(both.mapInArrow(decide, "u long, v long"), "similar")
