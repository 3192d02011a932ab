"""Near duplicates by SuperMinHash signatures, banding and verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.components import connected_components
from quire.session import materialize

from .common import hold, long_rows, lookup, slices, small, text_hash, texts
from .resemblance import forest, parity, similar
from .simhash import by_key, majority, shingles

WORDS, SIMILARITY = 5, 0.85
#: Sets of that similarity share none of the bands' cells once in 10**10 times.
BANDS, ROWS = 32, 4
LANES = BANDS * ROWS
#: Standard deviations by which more lowest bits of the components may differ than do on
#: average between sets of the similarity asked for.
DEVIATIONS = 6.5
#: Members of a band's cell that are compared in one place; sets most like the middle of a
#: larger cell, with which all of it is compared first.
CELL, HUBS = 512, 3
#: Bits of a set's parity for each of its members; pairs whose parities are compared at a time.
WIDE, AT_ONCE = 4, 1 << 14
#: Shingles that are ranked at a time.
CHUNK = 1 << 15

_LANE = np.arange(LANES, dtype=np.uint8)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(items: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The SuperMinHash signatures (n, LANES) of n sets: items (64-bit) and the set of each.
    A component is the least rank that an item has there, its whole part in the upper
    32 bits; those of an empty set are all ones.

    An item has a random permutation of the lanes, and rank j plus a random fraction at
    the j-th of it: so an item's ranks fall one in each whole number, which is what
    lowers the variance. Permutations are dealt step by step for all items at once. A
    set is done when all its components are below the next step; early, as a set of m
    items needs about LANES * log(LANES) / m steps."""
    out = np.full((n, LANES), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    for k in range(0, len(items), CHUNK):
        x, home = items[k : k + CHUNK], of[k : k + CHUNK].astype(np.int64)
        lanes = np.tile(_LANE, (len(x), 1))
        at = np.arange(len(x))
        for j in range(LANES):
            with np.errstate(over="ignore"):
                z = _mix(x + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
            other = j + (((z & _LOW) * np.uint64(LANES - j)) >> np.uint64(32)).astype(np.int64)
            lane = lanes[at, other]
            lanes[at, other] = lanes[at, j]
            np.minimum.at(flat, home * LANES + lane, np.uint64(j << 32) | (z >> np.uint64(32)))
            sets = np.unique(home)
            open_ = np.zeros(n, bool)
            open_[sets] = (out[sets] >> np.uint64(32)).max(axis=1) > j
            left = open_[home]
            if not left.any():
                break
            x, home, at = x[left], home[left], at[left]
    return out


def cells(signature: np.ndarray) -> np.ndarray:
    """A 64-bit cell for each band (n, BANDS), no two bands alike."""
    out = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), BANDS)).copy()
    for k in range(ROWS):
        with np.errstate(over="ignore"):
            out = _mix(out * np.uint64(31) + signature[:, k::ROWS])
    return out.view(np.int64)


def most_bits(similarity: float) -> int:
    """So many of the LANES lowest bits may differ between sets of that similarity: a bit
    does where the components do, half of the time."""
    p = (1 - similarity) / 2
    return int(LANES * p + DEVIATIONS * (LANES * p * (1 - p)) ** 0.5) + 1


def low_bits(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bits of the components, as two 64-bit numbers a set."""
    packed = np.packbits((signature & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    return packed[:, 0], packed[:, 1]


def sketches(docs: DataFrame, words: int = WORDS, anchors: bool = False) -> DataFrame:
    """row (a number of its own), doc_id, h (hash of the text), set (64-bit hash of its
    shingle set), n (members of the set), parity (see resemblance), fp and low (bits of the
    signature), cells (one for each band) of every whole text; anchors: and simhash, the
    SimHash fingerprint of the set."""

    def run(batches):
        hold("minhash", "", dict)
        for b in slices(batches, 200):
            own = [np.unique(shingles(t, words)) for t in texts(b)]
            n = np.array([len(x) for x in own], np.int64)
            signed = signatures(np.concatenate(own), np.repeat(np.arange(len(own)), n), len(own))
            names = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
            fp, low = low_bits(signed)
            found = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(own) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(cells(signed).reshape(-1)))
            columns = [*b.columns[:3], pa.array(names), pa.array(n), pa.array([parity(x, WIDE) for x in own], pa.binary()), pa.array(fp), pa.array(low), found]
            names_of = ["row", "doc_id", "h", "set", "n", "parity", "fp", "low", "cells"]
            if anchors:
                columns.append(pa.array(np.array([majority(x) for x in own], np.uint64).view(np.int64)))
                names_of.append("simhash")
            yield pa.RecordBatch.from_arrays(columns, names_of)

    docs = long_rows(docs)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("h"), "text")
    return own.mapInArrow(run, "row long, doc_id long, h long, set long, n long, parity binary, fp long, low long, cells array<long>" + (", simhash long" if anchors else ""))


_MEMBER = "cell long, set long, fp long, low long, n long"


def _first_round(batches, most: int):
    """Rows sorted by cell. Links (u, v) of a few spanning trees of each cell, and again
    the members of cells with more than these can hold."""
    names = [c.split()[0] for c in _MEMBER.split(", ")]

    def links(cell, name, fp, low, n):
        size = np.diff(np.append(starts := np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell)))
        many = np.repeat(size > 2, size)
        return forest(cell, name, fp, low, most), [x[many] for x in (cell, name, fp, low, n)]

    for (u, v), members in _by_key(batches, len(names), links):
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[none] * 5], ["u", "v", *names])
        none = pa.nulls(len(members[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, members)], ["u", "v", *names])


def _by_key(batches, columns: int, make):
    """What `make` gives for the arrays of whole keys, of batches sorted by the first
    column."""
    kept = None
    for b in batches:
        part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if kept is not None:
            part = [np.concatenate([x, y]) for x, y in zip(kept, part)]
        cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
        kept = [x[cut:] for x in part]
        if cut:
            yield make(*(x[:cut] for x in part))
    if kept is not None and len(kept[0]):
        yield make(*kept)


def _close(odd: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the parities (bytes, of sizes that are powers of two) at i and j differ in
    no more than `most` bits, the larger one folded to the size of the other."""
    size = np.array([len(x) for x in odd], np.int64)
    least, out = np.minimum(size[i], size[j]), np.zeros(len(i), bool)
    for s in np.unique(least).tolist():
        here = np.flatnonzero(size >= s)
        folded = np.zeros((len(odd), s // 8), np.uint64)
        for k in here.tolist():
            folded[k] = np.bitwise_xor.reduce(np.frombuffer(odd[k], np.uint64).reshape(-1, s // 8), axis=0)
        of = np.flatnonzero(least == s)
        for k in range(0, len(of), AT_ONCE):
            p = of[k : k + AT_ONCE]
            out[p] = np.bitwise_count(folded[i[p]] ^ folded[j[p]]).sum(axis=1, dtype=np.int64) <= most[p]
    return out


def across(cell: np.ndarray, root: np.ndarray, name: np.ndarray, fp: np.ndarray, low: np.ndarray, n: np.ndarray, odd: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell. u, v: pairs of sets of one cell that are not linked (their roots
    differ) and whose sizes, bits and parities allow the similarity. The parities, which
    few dissimilar sets get past, are looked at here, where pairs cost no row."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    ends, u, v = np.append(starts[1:], len(cell)), [name[:0]], [name[:0]]
    fp, low, most = fp.view(np.uint64), low.view(np.uint64), most_bits(similarity)
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist()):
        p = slice(a, b)
        near = np.bitwise_count(fp[p, None] ^ fp[None, p]).astype(np.int16) + np.bitwise_count(low[p, None] ^ low[None, p]) <= most
        near &= root[p, None] < root[None, p]
        near &= np.minimum(n[p, None], n[None, p]) >= similarity * np.maximum(n[p, None], n[None, p]) - 1e-6
        i, j = np.nonzero(near)
        if len(i):
            close = _close(odd[p], i, j, (1 - similarity) / (1 + similarity) * (n[p][i] + n[p][j]) + 1e-6)
            u.append(name[p][i[close]])
            v.append(name[p][j[close]])
    u, v = np.concatenate(u), np.concatenate(v)
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return pair[0], pair[1]


def _hubs(members: DataFrame) -> DataFrame:
    """members: those of crowded cells. u, v: each with the few sets of its cell whose bits
    are nearest to what most of the cell has. Copies of one text differ from it less
    than from one another, so this finds the text that a large family comes from."""

    def counted(batches):
        bits = lambda fp, low: np.unpackbits(np.stack([fp, low], axis=1).view(np.uint8), axis=1, bitorder="little")
        for b in batches:
            cell, fp, low = (b.column(k).to_numpy() for k in (0, 2, 3))
            own, at = np.unique(cell, return_inverse=True)
            ones = np.zeros((len(own), LANES), np.int64)
            np.add.at(ones, at, bits(fp, low))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(own) + 1) * LANES, LANES, dtype=np.int32)), pa.array(ones.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at)), listed], ["cell", "rows", "ones"])

    partial = members.mapInArrow(counted, "cell long, rows long, ones array<long>")
    total = partial.groupBy("cell").agg(F.sum("rows").alias("rows"), *[F.sum(F.get("ones", F.lit(k))).alias(f"b{k}") for k in range(LANES)])
    bit = lambda k: F.when(F.col(f"b{k}") * 2 > F.col("rows"), F.lit(-(1 << 63) if k % 64 == 63 else 1 << k % 64)).otherwise(F.lit(0)).cast("long")
    word = lambda ks: F.aggregate(F.array(*map(bit, ks)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    middle = small(materialize(total.select(F.col("cell").alias("of"), word(range(64)).alias("mid"), word(range(64, 128)).alias("dle")), "middle"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("mid"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("dle")))
    order = Window.partitionBy("cell").orderBy("far", "set")
    near = members.join(middle, members["cell"] == middle["of"]).select("cell", "set", far.alias("far")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= HUBS)
    hubs = small(materialize(near.select(F.col("cell").alias("of"), F.col("set").alias("hub")), "hubs"))
    return members.join(hubs, members["cell"] == hubs["of"]).where("set <> hub").select(F.col("set").alias("u"), F.col("hub").alias("v"))


def _part(by: str, n) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(7)), n)


def _dealt(shared: DataFrame, crowded: DataFrame, cell: int) -> DataFrame:
    """cell, root, set, fp, low, n, parity: members of cells whose members are not all linked. Those of
    crowded cells are dealt so that each member outside the cell's largest group
    meets all others, in places of bounded size; members of that group, which are
    linked, don't meet one another."""
    columns = ["root", "set", "fp", "low", "n", "parity"]
    if crowded.isEmpty():
        return shared.select("cell", *columns)
    known = small(crowded.select(F.col("cell").alias("of")))
    here = shared.join(known, shared["cell"] == known["of"], "left_semi")
    groups = here.groupBy("cell", "root").count()
    sizes = materialize(groups.groupBy("cell").agg(F.sum("count").alias("all"), F.max(F.struct("count", "root")).alias("most")), "sizes")
    half = cell // 2
    sizes = sizes.where(F.col("all") > F.col("most.count")).select(F.col("cell").alias("of"), F.col("most.root").alias("main"), F.ceil(F.col("all") / half).cast("int").alias("parts"), F.ceil((F.col("all") - F.col("most.count")) / half).cast("int").alias("rest"))
    placed = here.join(small(materialize(sizes, "mixed")), here["cell"] == F.col("of"))
    every = placed.withColumn("b", _part("set", F.col("parts"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)))
    other = placed.where("root <> main").withColumn("a", _part("set", F.col("rest"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = every.select("cell", *columns, "a", "b").unionAll(other.select("cell", *columns, "a", "b"))
    calm = shared.join(known, shared["cell"] == known["of"], "left_anti").select("cell", *columns)
    return calm.unionAll(split.select(F.xxhash64("cell", "a", "b").alias("cell"), *columns))


def classes(docs: DataFrame, seen: DataFrame, sets: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, cell: int = CELL, more: DataFrame | None = None) -> DataFrame:
    """node, root of the sets that others resemble. seen: sketches; sets: a row for each
    different set, none empty; more: pairs (u, v) of sets to look at besides.

    First a few spanning trees of each band's cell (of a large one, of parts of it, and
    links to its hubs) are verified, which joins most of what belongs together. Then
    all pairs of a cell that this leaves apart are verified too, as far as sizes and
    bits allow the similarity: so a pair is missed only where all bands miss it."""
    members = sets.select(F.explode("cells").alias("cell"), "set", "fp", "low", "n")
    crowded = materialize(members.groupBy("cell").count().where(F.col("count") > cell), "crowded")
    if crowded.isEmpty():
        dealt, hot = members, None
    else:
        of = small(crowded.select(F.col("cell").alias("of"), F.ceil(F.col("count") / (cell // 2)).cast("int").alias("parts")))
        found = members.join(of, members["cell"] == of["of"], "left")
        hot = materialize(found.where("of is not null").select("cell", "set", "fp", "low", "n", "parts"), "hot")
        dealt = found.where("of is null").select("cell", "set", "fp", "low", "n").unionAll(hot.select(F.xxhash64("cell", _part("set", F.col("parts"))).alias("cell"), "set", "fp", "low", "n"))
    round_one = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _first_round(batches, most_bits(similarity)), f"u long, v long, {_MEMBER}")
    looked = materialize(round_one, "cells")
    likely = looked.where("u is not null").select("u", "v")
    shared = looked.where("cell is not null").select("cell", "set", "fp", "low", "n")
    if hot is not None:
        likely = likely.unionAll(_hubs(hot.drop("parts")))
        shared = shared.unionAll(hot.drop("parts"))
    likely = likely if more is None else likely.unionAll(more)
    roots = connected_components(similar(docs, seen, sets, likely, words, similarity))
    named = small(roots.withColumnRenamed("node", "of"))
    rooted = materialize(shared.join(named, shared["set"] == named["of"], "left").select("cell", F.coalesce("root", "set").alias("root"), "set", "fp", "low", "n"), "rooted")
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("cell")
    parities = sets.select("set", "parity")
    apart = materialize(rooted.join(mixed, "cell", "left_semi").join(parities, "set").select("cell", "root", "set", "fp", "low", "n", "parity"), "apart")

    def run(batches):
        return by_key(batches, 7, lambda *part: across(*part, similarity))

    apart = _dealt(apart, crowded, cell).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")
    rest = similar(docs, seen, sets, apart, words, similarity)
    if rest.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(rest))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles (size of the set of `words`-word shingles, A-Z lower-cased), component_id
    (smallest doc_id that links reach), kept (doc_id = component_id) for every document.

    Texts are linked if their sets have a Jaccard similarity of at least `similarity`;
    whole sets confirm it. Equal sets are one from the start, so copies cost no
    pairs. A text with fewer words is one shingle; one without words (null and empty
    too) has the empty set and is linked with nothing. A doc_id on several rows joins
    nothing by itself. Rows with a null doc_id link what lies between others; their
    component_id is the smallest doc_id of the component too (null if it has none),
    and kept is null. Ties can't arise. Texts of any length are taken whole, extra columns
    are ignored, an empty table gives no rows. `cell` affects the work, not the
    result."""
    seen = materialize(sketches(docs, words), "sketches")
    first = materialize(seen.where("n > 0").groupBy("set").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "first")
    one = small(first.select("row"))
    sets = materialize(seen.select("set", "row", "fp", "low", "cells", "n", "parity").join(one, "row", "left_semi"), "sets")
    roots = classes(docs, seen, sets, words, similarity, cell)
    linked = roots.join(first, roots["node"] == first["set"]).select("node", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("of_all"))
    named = linked.join(of_root, "root").select("node", "of_all")
    of_set = first.join(named, first["set"] == named["node"], "left").select("set", F.coalesce("of_all", "least").alias("component_id"))
    rows = lookup(seen.select("doc_id", F.col("n").alias("n_shingles"), "set"), materialize(of_set, "of_set"), ["set"], ["doc_id"])
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", alone.alias("component_id"), (F.col("doc_id") == alone).alias("kept"))
