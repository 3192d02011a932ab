"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize, materialize_sorted, release, scratch, with_settings

from .common import WHITE, column, free, hold, long_rows, slices, texts

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
#: Lines of the input that are worth a bucket of the runs, up to the session's shuffle
#: partitions.
PER_BUCKET = 200_000
#: So many common keys (24 bytes each) go to every executor; more are joined.
BROADCAST = 200_000


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line without white space at its ends, A-Z lower-cased;
    None if that has fewer than min_chars code points."""
    line = line.strip(WHITE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key, doc_id: each long-enough line key once for each row that has it."""

    def run(batches):
        hold("linededup", "", dict)
        for b in slices(batches):
            keys, ids = [], []
            for i, t in zip(column(b, "doc_id"), texts(b)):
                if i is not None and len(t) >= min_chars:
                    found = {k for line in t.split("\n") if (k := line_key(line, min_chars))}
                    keys += found
                    ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key binary, doc_id long")


class LineRuns:
    """A log-structured store of line keys: (key, n_docs, last_doc).

    add() splits a batch by merge anti-joins with the runs: keys that no run holds
    become a run of level 0, so each key is in one run, and what the batch adds to
    known keys becomes a run of increments. As soon as a level holds `fanout` runs
    they are merged into one of the next level, so a key is rewritten about
    log(batches) times, not once a batch. Batches must not share documents. Runs
    are Parquet in the shared folder, in the same buckets of the key and sorted by
    it: joins and merges go bucket by bucket and exchange nothing."""

    def __init__(self, fanout: int = FANOUT, buckets: int | None = None):
        self.fanout, self.buckets = fanout, buckets
        self.levels: dict[int, list[DataFrame]] = {}
        self.increments: dict[int, list[DataFrame]] = {}

    def _write(self, df: DataFrame) -> DataFrame:
        if self.buckets is None:
            self.buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return materialize_sorted(df, "run", "key", self.buckets)

    def add(self, hashes: DataFrame) -> DataFrame:
        """hashes: key, doc_id of one batch. A document counts once for a key, even
        if its row is repeated. Gives the run of the batch's fresh keys."""
        counts = hashes.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self.levels:
            fresh = self._write(counts)
        else:
            batch = self._write(counts)
            unseen = batch
            for r in self.runs():
                unseen = unseen.join(r.select("key").hint("merge"), "key", "left_anti")
            fresh = self._write(unseen)
            self._put(self.increments, self._write(batch.join(fresh.select("key").hint("merge"), "key", "left_anti")))
            release(batch)
        self._put(self.levels, fresh)
        return fresh

    def _put(self, levels: dict[int, list[DataFrame]], run: DataFrame) -> None:
        level = 0
        levels.setdefault(level, []).append(run)
        while len(levels[level]) >= self.fanout:
            levels.setdefault(level + 1, []).append(self._merged(levels.pop(level)))
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, by full merge joins."""
        out = runs[0]
        for r in runs[1:]:
            a, b = out, r.hint("merge")
            n = F.coalesce(a["n_docs"], F.lit(0)) + F.coalesce(b["n_docs"], F.lit(0))
            out = a.join(b, a["key"] == b["key"], "full_outer").select(F.coalesce(a["key"], b["key"]).alias("key"), n.alias("n_docs"), F.greatest(a["last_doc"], b["last_doc"]).alias("last_doc"))
        return self._write(out)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels.values() for r in level]

    def common(self, min_docs: int) -> DataFrame:
        """key, n_docs, last_doc of the keys in min_docs documents or more: each run
        of keys merged with the increments."""
        known = [r for level in self.increments.values() for r in level]
        more = (self._merged(known) if len(known) > 1 else known[0]).hint("merge") if known else None
        parts = []
        for r in self.runs():
            if more is not None:
                n = r["n_docs"] + F.coalesce(more["n_docs"], F.lit(0))
                r = r.join(more, r["key"] == more["key"], "left").select(r["key"], n.alias("n_docs"), F.greatest(r["last_doc"], more["last_doc"]).alias("last_doc"))
            parts.append(r.where(F.col("n_docs") >= min_docs))
        return reduce(DataFrame.unionAll, parts)


def new_lines(store: LineRuns, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Incremental use: key, n_docs, last_doc of the batch's lines that no earlier
    batch holds; the batch is then part of the runs. The result is a written run, so
    it does not change when later batches come."""
    return store.add(line_hashes(docs, min_chars))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """key, last_doc of the keys found in min_docs documents or more, and key, doc_id
    of all lines. A common key stays in last_doc, its largest doc_id, alone.

    The hashes are extracted in one pass and dealt to batches by document; one batch
    after the other goes through the runs."""
    staged = materialize(line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "hashes", even=True)
    # one task for each bucket, so that each writes one file
    partitions = "spark.sql.shuffle.partitions"
    now = staged.sparkSession.conf.get(partitions)
    dealt = with_settings(staged, {partitions: (now, str(min(int(now), staged.count() // PER_BUCKET + 1)))})
    with scratch(docs.sparkSession) as keep:
        store = LineRuns(fanout, int(dealt.sparkSession.conf.get(partitions)))
        for k in range(batches):
            store.add(dealt.where(F.col("batch") == k).select("key", "doc_id"))
        common = keep(materialize(store.common(min_docs).select("key", "last_doc"), "common", even=True))
    return common, staged.select("key", "doc_id")


def _cut(text: str, lost, min_chars: int) -> tuple[list[str], int]:
    lines = text.split("\n")
    return [x for x in lines if (k := line_key(x, min_chars)) is None or not lost(k)], len(lines)


def _rewritten(df: DataFrame, docs: DataFrame, losing, min_chars: int) -> DataFrame:
    """df: all columns of docs and one that `losing` makes, with the row's doc_id, a
    test of keys from (None: nothing is lost). n_lines and n_dropped are added."""
    counts = [free(c, docs.columns) for c in ("n_lines", "n_dropped")]
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        hold("linededup", "", dict)
        test = losing()
        for b in slices(batches):
            kept, n, dropped = [], [], []
            for t, i, x in zip(b.column(at).to_pylist(), b.column(key).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                t = t or ""
                lost = test(i, x)
                lines, total = _cut(t, lost, min_chars) if lost else (None, t.count("\n") + 1)
                kept.append(t if lines is None or len(lines) == total else "\n".join(lines))
                n.append(total)
                dropped.append(0 if lines is None else total - len(lines))
            arrays = b.columns[:-1]
            arrays[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*b.schema.names[:-1], *counts])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return df.mapInArrow(run, schema)


def without_lines(docs: DataFrame, common: DataFrame, staged: DataFrame, min_chars: int = MIN_CHARS, broadcast: int = BROADCAST) -> DataFrame:
    """All columns of docs, the text without its lost lines, and two last columns
    n_lines (before) and n_dropped (with an underscore more where docs has a column
    of that name). common and staged are from repeated_lines.

    Up to `broadcast` common keys are counted and sent to the executors, and texts
    stay where they are. More are joined with the lines by key (AQE splits a key
    that is in very many) and the lost keys with their documents; a document's list
    holds no more than its own lines."""
    docs, extra = long_rows(docs), free("_keys", docs.columns)
    if common.count() <= broadcast:
        keys = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["last_doc"] for r in common.collect()})

        def everywhere():
            last = keys.value
            return (lambda i, _: (lambda k: last.get(k, i) != i) if i is not None else None) if last else (lambda i, _: None)

        return _rewritten(docs.select("*", F.lit(None).cast("boolean").alias(extra)), docs, everywhere, min_chars)
    lost = staged.join(common, "key").where("doc_id <> last_doc").groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set("key").alias(extra))
    both = docs.join(lost, docs["doc_id"].cast("long") == lost["_of"], "left").drop(lost["_of"])
    return _rewritten(both, docs, lambda: lambda i, keys: set(keys).__contains__ if keys else None, min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped for every document.

    A null or empty text is one empty line; an empty table gives no rows; texts and
    lines of any length are taken whole. A row with a null doc_id counts for no key
    and keeps its lines. Rows that share a doc_id are one document when documents
    are counted; each keeps its own row. Ties can't arise: of a common key the
    largest doc_id keeps all its lines. Extra columns are ignored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return without_lines(own, *repeated_lines(own, min_chars, min_docs, batches, fanout), min_chars, broadcast)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, last_doc IS NOT NULL AND doc_id <> last_doc AS lost
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
