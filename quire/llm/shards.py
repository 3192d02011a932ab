"""Uniform sharding by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize

from .common import free, long_rows


SHARDS, SEED, OVERHEAD = 40, 11, 16
#: Rows of a shard that are exchanged together.
BLOCK = 1 << 18


def capacities(n_rows: int, n_shards: int) -> np.ndarray:
    """Shard sizes that differ by one at most."""
    return np.array([n_rows // n_shards + (k < n_rows % n_shards) for k in range(n_shards)], np.int64)


def communication_matrix(rows: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard, drawn as a uniform shuffle
    would have it: partition by partition from what is left of every shard,
    without replacement. Rows sum to `rows`, columns to `shards`, exactly."""
    rng, left = np.random.default_rng(seed), shards.copy()
    out = np.zeros((len(rows), len(shards)), np.int64)
    for p, n in enumerate(rows.tolist()):
        rest, total = n, int(left.sum())
        for k in range(len(shards)):
            total -= int(left[k])
            out[p, k] = _hypergeometric(rng, int(left[k]), total, rest)
            rest -= out[p, k]
        left -= out[p]
    return out


def _log_chances(k: int, good: int, bad: int, n: int) -> float:
    """Log of the chance of k good ones among n drawn, up to a constant."""
    return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good, for numbers of any size. Where
    numpy's draw holds (fewer than 10**9 on either side) it is that; beyond, the same
    law by rejection: a point is drawn evenly from a rectangle around the region
    u <= sqrt(chance(center + v / u)), and counts if it lies inside."""
    if not n or not good:
        return 0
    if not bad:
        return n
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _by_rejection(rng, good, bad, n)


def _by_rejection(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    total, low, high = good + bad, max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)) + 0.5)
    top = _log_chances(mode, good, bad, n)
    # half the width of the region: at u = 1 and beyond the hat of a log-concave law
    width = 2.0 * spread + 2.0
    while True:
        u, v = 1.0 - rng.random(), rng.random() - 0.5
        k = math.floor(mode + 0.5 + 2 * width * v / u)
        if low <= k <= high and 2 * math.log(u) <= _log_chances(k, good, bad, n) - top:
            return k


def keyed_permutation(at: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0..size-1 for each element: a Feistel network over the
    next even number of bits, walked until it is back in range. It needs no
    memory for the shard, so a shard of any size is permuted wherever its rows are."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x, half, mask, key):
        left, right = x >> half, x & mask
        for r in range(rounds):
            z = right * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(r + 1) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(at.astype(np.uint64), half, mask, key)
        wide = np.flatnonzero(out >= size.astype(np.uint64))
        while len(wide):
            out[wide] = once(out[wide], half[wide], mask[wide], key[wide])
            wide = wide[out[wide] >= size[wide].astype(np.uint64)]
    return out.astype(np.int64)


def assign(rows: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of rows and shard, slot (0.. without gaps): a uniform shuffle with
    shard sizes that differ by one at most. Where rows has a column shard or slot,
    the new one has an underscore more.

    The rows are written first with their partition and place in it, so a task
    that runs again finds the same rows in the same places. The driver sees one
    count for each partition and draws the communication matrix. Each partition
    permutes its rows, which fixes the shard of each and its place there, then
    the shard is permuted again; the exchange moves rows by shard in blocks, so a
    task holds no more than a block."""
    spark, columns = rows.sparkSession, rows.columns
    shard_name, slot_name, place_name = (free(c, columns) for c in ("shard", "slot", "_place"))
    placed = materialize(rows.select("*", F.monotonically_increasing_id().alias(place_name)), "placed")
    counts = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright(place_name, 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    sizes = capacities(sum(counts.values()), n_shards)
    matrix = communication_matrix(np.array([counts[p] for p in parts], np.int64), sizes, seed)
    plan = spark.sparkContext.broadcast(({p: k for k, p in enumerate(parts)}, np.cumsum(matrix, axis=1), np.cumsum(matrix, axis=0) - matrix, sizes))

    def run(batches):
        row, ends, offsets, sizes = plan.value
        last, order = None, None
        for b in batches:
            place = b.column(b.num_columns - 1).to_numpy()
            shard, at = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
            for p in np.unique(place >> 33).tolist():
                if p != last:
                    k = row[p]
                    last, order = p, np.random.default_rng([seed, p]).permutation(ends[k, -1])
                own = np.flatnonzero(place >> 33 == p)
                local = order[place[own] & ((1 << 33) - 1)]
                shard[own] = np.searchsorted(ends[k], local, side="right")
                first = np.concatenate([[0], ends[k][:-1]])[shard[own]]
                at[own] = local - first + offsets[k][shard[own]]
            slot = keyed_permutation(at, sizes[shard], shard.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(seed))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shard.astype(np.int32)), pa.array(slot)], [*columns, shard_name, slot_name])

    schema = T.StructType([*rows.schema.fields, T.StructField(shard_name, T.IntegerType()), T.StructField(slot_name, T.LongType())])
    sent = placed.mapInArrow(run, schema)
    return sent.repartition(shard_name, F.floor(F.col(slot_name) / BLOCK)).sortWithinPartitions(shard_name, slot_name)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents.

    The law is `rows`: counts of shards differ by one at most. size is the UTF-8
    bytes of the text and 16; a null text counts as empty, its crc32 is 0. Where a
    row goes depends on seed and input order alone, so equal texts, repeated rows
    and null doc_ids are rows like any other. grown_shard is null: under this law
    a further shard deals all rows anew. Empty table: no rows. Extra columns are
    ignored. The texts are moved; size and text_crc32 are of what arrives."""
    dealt = assign(long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n_shards, seed)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole documents as Parquet, a folder for each shard, in slot order."""
    assign(long_rows(docs), n_shards, seed).write.partitionBy(free("shard", docs.columns)).parquet(path)
