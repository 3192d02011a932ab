"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.components import connected_components
from quire.session import materialize

from .common import hold, long_rows, lookup, slices, texts

WORDS, SEED, DISTANCE, HOT = 3, 42, 2, 512
#: Distinct fingerprints that are worth a task, up to the session's shuffle partitions.
PER_TASK = 5_000
#: Shingles whose bits are counted at a time.
CHUNK = 65_536


def shingles(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit hashes of the shingles, repeats included; A-Z are lower-cased. Fewer
    words than a shingle has make one shingle; no words, none."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, "<u8")
    runs = zip(*(w[k:] for k in range(words))) if len(w) > words else [w]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in map(b" ".join, runs)), "<u8", max(1, len(w) - words + 1))


def majority(hashes: np.ndarray) -> int:
    """64 bits; one is set if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    return majority(shingles(text, words, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        hold("simhash", "", dict)
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in texts(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, anchor, home for each fingerprint (uint64) and anchor near it.

    The anchors are the words of the perfect [31,26] Hamming code, one set for
    each half of the fingerprint (its top bit is left out). The covering radius
    is 1. Of two fingerprints that differ in 2 bits, one half differs in 1 at
    most: a half lies within 1 of its one home anchor, and the other fingerprint's
    half within 1 + 1 of the same anchor. So each goes to all anchors within 2:
    16, or 1 if it is a code word itself."""
    rows, found, homes = [], [], []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        s = np.zeros(len(x), np.uint64)
        for k in range(31):
            s ^= ((x >> np.uint64(k)) & np.uint64(1)) * np.uint64(k + 1)
        one = np.uint64(1)
        flip = lambda p: np.where(p > 0, one << (np.maximum(p, one) - one), np.uint64(0))
        rows.append(np.arange(len(x)))
        found.append((x ^ flip(s)) | np.uint64(half << 31))
        homes.append(np.ones(len(x), bool))
        for p in range(1, 32):
            q = s ^ np.uint64(p)
            at = np.flatnonzero((s > 0) & (q > np.uint64(p)))
            rows.append(at)
            found.append((x[at] ^ flip(np.full(len(at), p, np.uint64)) ^ flip(q[at])) | np.uint64(half << 31))
            homes.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(found).view(np.int64), np.concatenate(homes)


def _replicas(distinct: DataFrame) -> DataFrame:
    """anchor, fp, home: every fingerprint at every anchor near it."""

    def run(batches):
        for part in slices(batches, 2000):
            fp = part.column(0).to_numpy(zero_copy_only=False)
            row, anchor, home = anchors(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as links of each node to the smallest of its group."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        after = root.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        np.minimum.at(after, root[left], low)
        np.minimum.at(after, root[right], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _compare(anchor, fp, home, distance: int):
    """Links between rows of the same anchor; rows are sorted by anchor."""
    left, right, bits = [], [], fp.view(np.uint64)
    i, shift = np.arange(len(anchor) - 1), 1
    while len(i):
        i = i[anchor[i] == anchor[i + shift]]
        j = i + shift
        near = i[(home[i] | home[j]) & (np.bitwise_count(bits[i] ^ bits[j]) <= distance)]
        left.append(fp[near])
        right.append(fp[near + shift])
        shift += 1
        i = i[i + shift < len(anchor)]
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def by_key(batches, columns: int, links):
    """Batches whose first column is sorted: `links` of the arrays of whole keys, as
    batches of u, v. What is held is one batch and one key's rows."""
    kept = None

    def out(part):
        u, v = links(*part)
        return [pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])] if len(u) else []

    for b in batches:
        part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if kept is not None:
            part = [np.concatenate([x, y]) for x, y in zip(kept, part)]
        cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
        kept = [x[cut:] for x in part]
        if cut:
            yield from out([x[:cut] for x in part])
    if kept is not None and len(kept[0]):
        yield from out(kept)


def _within_anchors(cold: DataFrame, distance: int) -> DataFrame:
    """cold: replicas at anchors of bounded size. u, v: a few links for each group
    of fingerprints that are linked at an anchor, not all pairs of it."""

    def run(batches):
        return by_key(batches, 3, lambda *part: _stars(*_compare(*part, distance)))

    return cold.select("anchor", "fp", "home").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "u long, v long")


def _around(hot: DataFrame) -> DataFrame:
    """u, v for fingerprints at crowded anchors, in time proportional to their
    number: each goes to itself and its 64 neighbours at one differing bit. Two
    that differ in at most 2 bits meet at one of these, all that meet differ in
    at most 2, and no more than 65 can meet."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.when(k == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    met = hot.repartition("fp").select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """u, v: links that connect exactly the fingerprints (fp) at DISTANCE or fewer
    differing bits. An anchor with over `hot` fingerprints is not compared in one
    place: its fingerprints go another exact way."""
    # a fingerprint makes 31 rows: dealt out first, so that a few tasks don't make them all
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replicas = _replicas(distinct.repartition(min(n, distinct.count() // PER_TASK + 1), "fp"))
    crowded = materialize(replicas.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "crowded")
    if crowded.isEmpty():
        return _within_anchors(replicas, DISTANCE)
    calm = _within_anchors(replicas.join(crowded, "anchor", "left_anti"), DISTANCE)
    return calm.unionAll(_around(replicas.join(crowded, "anchor", "left_semi").select("fp").distinct()))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id
    that links reach) for every document.

    A text without words (null and empty ones too) has fingerprint zero and is
    linked like any other; texts of any length are taken whole; an empty table gives
    no rows. Links join fingerprints, not doc_ids: equal fingerprints are compared
    once, so thousands of copies cost no more than one, a doc_id on several rows
    joins nothing by itself, and rows with a null doc_id link what lies between
    others like any row. Their own component_id is the smallest doc_id of the
    component too (null if it has none). Ties can't arise. Extra columns are
    ignored. Links are never expanded into all pairs, and nothing but counts reaches
    the driver."""
    fps = materialize(fingerprints(docs), "fingerprints", even=True)
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct, hot))
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("of_all")), "root").select(F.col("fp").alias("node"), "of_all")
    of_fp = distinct.join(named, distinct["fp"] == named["node"], "left").select("fp", F.coalesce("of_all", "least").alias("component_id"))
    return lookup(fps, materialize(of_fp, "of_fp"), ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
