"""A positional index of page texts, for searches that don't read all of them.

In a folder: runs of postings and of pages, and manifests that name the runs in force. A
page's key is the number of the run that took it in (`at`) and its own in that run (`no`).
A row of postings is a trigram of bytes (A-Z lower-cased) and, for a block of pages, those
that have it, how often and at which offsets, as differences in bytes of seven bits: about
two bytes for a byte of text. Blocks are made where the pages are read and nothing is
exchanged. A run's postings are in buckets by the trigram's first byte, sorted by trigram,
so a search opens the buckets of its own trigrams and skips most of these."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import fixed
from quire.functions.text import ascii_lower
from quire.operators.search import CONTEXT, in_context

#: Runs beyond this are merged into one. Folders that a run's pages are dealt to.
RUNS, SLOTS = 8, 64
#: Bytes of text, about, whose postings are rows together.
BLOCK = 2 << 20
#: How runs are written; manifests say so.
FORMAT = 2
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_POSTINGS = "gram int, at int, first long, pages binary, counts binary, offsets binary, bucket int"
_PAGES = "at int, no long, doc_id string, page int, text string, slot int"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (none negative) as bytes with seven bits each, the last of a number below
    128; and where each number ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    starts, out = ends - size, np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[starts[some] + k] = values[some] >> 7 * k & 127 | (size[some] > k + 1) << 7
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128) + 1
    size = np.diff(ends, prepend=0)
    starts, out = ends - size, np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[some] |= (b[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def _binaries(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Packed numbers as binaries; rows: place of the first number of each."""
    data, ends = packed(values)
    at = np.append(np.concatenate([[0], ends])[rows], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _block(no: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """The postings of pages, whose numbers grow. Two zero bytes follow each text."""
    size = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer((b"\0\0".join(texts) + b"\0\0").translate(_LOWER), np.uint8)
    starts = np.cumsum(size + 2) - size - 2
    inside = np.ones(len(b), bool)
    inside[starts + size] = inside[starts + size + 1] = False
    at = np.flatnonzero(inside)
    key = (b[at].astype(np.uint64) << 16 | b[at + 1].astype(np.uint64) << 8 | b[at + 2]) << 32 | at.astype(np.uint64)
    key.sort()
    gram, at = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int64)
    page = np.repeat(np.arange(len(texts), dtype=np.int32), size + 2)[at]
    offset = at - starts[page]
    new = np.ones(len(key), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (page[1:] != page[:-1])
    pairs = np.flatnonzero(new)
    offset[1:] -= np.where(new[1:], 0, offset[:-1])
    of, pages = gram[pairs], no[page[pairs]]
    rows = np.flatnonzero(np.diff(of, prepend=-1))
    steps = np.diff(pages, prepend=0)
    steps[rows] = 0
    columns = [pa.array(of[rows] >> 16), pa.array(of[rows]), pa.array(pages[rows]), _binaries(steps, rows), _binaries(np.diff(pairs, append=len(key)), rows), _binaries(offset, pairs[rows])]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "gram", "first", "pages", "counts", "offsets"])


def postings(pages: DataFrame) -> DataFrame:
    """bucket, gram, first, pages, counts, offsets of no, text: `first` is the number of a
    row's first page. Null and empty texts have none."""

    def run(batches):
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            k = 0
            while k < b.num_rows:
                n = max(1, int(np.searchsorted(ends, (int(ends[k - 1]) if k else 0) + BLOCK, side="right")) - k)
                yield _block(b.column(0).slice(k, n).to_numpy(), b.column(1).slice(k, n).to_pylist())
                k += n

    own = pages.where("text <> ''").select("no", F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "bucket int, gram int, first long, pages binary, counts binary, offsets binary")


def _listed(found: DataFrame) -> DataFrame:
    """gram, at, no, offsets: rows of postings, a row for each page."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                gram, at, first, pages, counts, offsets = (c[k] for c in b.columns)
                no = np.cumsum(unpacked(pages.as_py())) + first.as_py()
                n, steps = unpacked(counts.as_py()), unpacked(offsets.as_py())
                ends, upto = np.cumsum(n), np.cumsum(steps)
                starts = ends - n
                own = (upto - np.repeat(upto[starts] - steps[starts], n)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)).astype(np.int32)), pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.repeat(gram, len(no)), pa.repeat(at, len(no)), pa.array(no), lists], ["gram", "at", "no", "offsets"])

    return found.select("gram", "at", "first", "pages", "counts", "offsets").mapInArrow(run, "gram int, at int, no long, offsets array<int>")


def _slot():
    """Neighbours, 4,096 of a task, are in one folder. (Spark's numbers have the task above
    33 bits.)"""
    return F.expr(f"cast(pmod(shiftright(no, 33) + shiftright(no & 8589934591, 12), {SLOTS}) AS int)")


class TextIndex:
    """An index in the folder `path`, which driver and executors share. One writer at a
    time; readers see the state of the last manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def state(self) -> dict:
        """number, runs in force, and batches taken in so far."""
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return {"number": -1, "runs": [], "batches": []}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"number": -1, "runs": [], "batches": []}
        state = json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect()))
        if state.pop("format", 1) != FORMAT:
            raise RuntimeError(f"the index {self.path} was written in another format")
        return state

    def _commit(self, before: dict, runs: list[str], batches: list[str]) -> None:
        """A new manifest, written aside and renamed; it must not be there yet."""
        state = {"number": before["number"] + 1, "runs": runs, "batches": batches}
        name = f"{state['number']:08d}"
        fs, draft = self._fs(f"{self.path}/manifests/{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state | {"format": FORMAT}).encode()))
        out.close()
        if fs.exists(self._fs(f"{self.path}/manifests/{name}.json")[1]) or not fs.rename(draft, self._fs(f"{self.path}/manifests/{name}.json")[1]):
            raise RuntimeError(f"another writer changed the index {self.path}")

    def _write(self, what: str, rows: DataFrame, run: str) -> None:
        by, *order = ("bucket", "gram") if what == "postings" else ("slot", "at", "no")
        rows.sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(f"{self.path}/{what}/{run}")

    def add(self, page_text: DataFrame, batch: str) -> bool:
        """Takes in doc_id, page, text as a run. A batch is named by the caller; one that was
        taken in before is left out, so that a batch that is sent again counts once. A run
        that was begun and never committed is written over. An empty batch is one like
        any other. False if it was left out."""
        state = self.state()
        if batch in state["batches"]:
            return False
        number = state["number"] + 1
        run = f"b{number:08d}"
        own = page_text.select(F.lit(number).alias("at"), F.monotonically_increasing_id().alias("no"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("text").cast("string").alias("text"))
        self._write("pages", own.withColumn("slot", _slot()), run)
        self._write("postings", postings(self._pages([run])).withColumn("at", F.lit(number)), run)
        self._commit(state, [*state["runs"], run], [*state["batches"], batch])
        if len(state["runs"]) + 1 > RUNS:
            self.compact()
        return True

    def compact(self) -> None:
        """Merges all runs into one. What searches still read of the old ones stays until
        vacuum()."""
        state = self.state()
        if len(state["runs"]) < 2:
            return
        run = f"m{state['number'] + 1:08d}"
        self._write("pages", self._pages(state["runs"]).hint("rebalance", F.col("slot")), run)
        self._write("postings", self._postings(state["runs"]).hint("rebalance", F.col("bucket")), run)
        self._commit(state, [run], state["batches"])

    def vacuum(self) -> None:
        """Deletes runs that are not in force."""
        live = set(self.state()["runs"])
        for what in ("postings", "pages"):
            fs, folder = self._fs(f"{self.path}/{what}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if s.getPath().getName() not in live:
                    fs.delete(s.getPath(), True)

    def _postings(self, runs: list[str]) -> DataFrame:
        return self._union("postings", _POSTINGS, runs)

    def _pages(self, runs: list[str]) -> DataFrame:
        return self._union("pages", _PAGES, runs)

    def _union(self, what: str, schema: str, runs: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{what}/{run}") for run in runs]
        for k, more in enumerate(frames):
            out = more if k == 0 else out.unionByName(more)
        return out

    def candidates(self, query: str) -> DataFrame:
        """doc_id, page, starts: offsets at which all trigrams of the query stand in their
        places. A query of one or two bytes takes all trigrams that start with it, which
        stand in one bucket."""
        return self._found(query, "doc_id", "page", "starts")

    def _found(self, query: str, *columns: str) -> DataFrame:
        held = self._starts(query).withColumn("slot", _slot())
        return self._pages(self.state()["runs"]).join(held, ["slot", "at", "no"]).select(*columns)

    def _starts(self, query: str) -> DataFrame:
        """at, no, starts of the pages that candidates() has."""
        q = list(query.encode().translate(_LOWER))
        found = self._postings(self.state()["runs"])
        if len(q) < 3:
            low = int.from_bytes(bytes(q + [0] * (3 - len(q))), "big")
            high = int.from_bytes(bytes(q + [255] * (3 - len(q))), "big")
            held = _listed(found.where((F.col("bucket") == q[0]) & F.col("gram").between(low, high)))
            return held.groupBy("at", "no").agg(F.sort_array(F.flatten(F.collect_list("offsets"))).alias("starts"))
        grams: dict[int, list[int]] = {}
        for k in range(len(q) - 2):
            grams.setdefault(q[k] << 16 | q[k + 1] << 8 | q[k + 2], []).append(k)
        held = _listed(found.where(F.col("bucket").isin(sorted({g >> 16 for g in grams})) & F.col("gram").isin(list(grams))))
        of = F.create_map(*(x for g, places in grams.items() for x in (F.lit(g), F.array(*map(F.lit, places)))))
        lists = held.select("at", "no", F.explode(F.transform(of[F.col("gram")], lambda k: F.transform("offsets", lambda o: o - k))).alias("starts"))
        all_ = lists.groupBy("at", "no").agg(F.collect_list("starts").alias("lists")).where(F.size("lists") == len(q) - 2)
        met = F.aggregate(F.slice("lists", 2, len(q)), F.get("lists", F.lit(0)), F.array_intersect)
        return all_.select("at", "no", F.sort_array(met).alias("starts")).where(F.size("starts") > 0)

    def search(self, query: str, context: int = CONTEXT) -> DataFrame:
        """doc_id, page, offset, context, as search() gives them: hits without overlap, from
        the left. The pages of hits are read from the folders that they are in, and each
        hit is held against the text. An empty query has no hits, as an empty index."""
        q, size = query.translate({c: c + 32 for c in range(65, 91)}), len(query.encode())
        pages = self._pages(self.state()["runs"])
        if not query or not self.state()["runs"]:
            return pages.limit(0).select("doc_id", "page", F.lit(0).cast("long").alias("offset"), F.lit("").alias("context"))
        texts = self._found(query, "doc_id", "page", "text", "starts")
        low = texts.withColumn("low", fixed(ascii_lower("text").cast("binary")))
        true = F.filter("starts", lambda o: F.substr(F.col("low"), o + 1, F.lit(size)) == F.lit(q.encode()))
        apart = F.aggregate(true, F.array().cast("array<int>"), lambda a, o: F.when(o >= F.coalesce(F.try_element_at(a, F.lit(-1)) + size, F.lit(0)), F.concat(a, F.array(o))).otherwise(a)) if _overlaps(q.encode()) else true
        hits = low.select("doc_id", "page", "text", F.explode(apart).alias("o")).withColumn("offset", F.col("o").cast("long"))
        return in_context(hits, size, context)


def _overlaps(q: bytes) -> bool:
    """Whether two hits of q can overlap: it ends as it starts."""
    return any(q.endswith(q[:k]) for k in range(1, len(q)))
