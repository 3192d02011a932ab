"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, column, crc_mod, hold, in_fold, long_rows, slices, texts

DIM, SEED, MOD, FOLD = 1024, 7, 4, 2
UNKNOWN = "und"
#: Letters at a time, so that a very long text needs no more memory.
CHUNK = 1 << 18


class Space:
    """Random letter vectors of +1 and -1, made from seed and code point when first
    met, and vectors of letter trigrams: the letters' vectors, permuted (rotated)
    by their place, bound by multiplication."""

    def __init__(self, dim: int = DIM, seed: int = SEED, cached: int = 60_000):
        self.dim, self.seed, self.cached = dim, seed, cached
        self.letters = Bounded(20_000, self._letter)
        self.table = np.empty((1024, dim), np.int8)
        self.place: dict[int, int] = {}
        self.code = np.zeros(0x110000, np.int32)
        self.known = np.zeros(0x110000, bool)

    def _letter(self, cp: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, cp]).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        """A row for each trigram (three code points of 21 bits)."""
        place = self.place
        if len(place) + len(trigrams) > self.cached:
            place.clear()
        if len(trigrams) > self.cached:
            raise ValueError("more trigrams than the table holds")
        at = np.empty(len(trigrams), np.int64)
        for k, g in enumerate(trigrams.tolist()):
            p = place.get(g)
            if p is None:
                p = place[g] = len(place)
                if p >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                a, b, c = g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF
                self.table[p] = np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]
            at[k] = p
        return self.table[at]

    def trigrams(self, text: str, chunk: int = CHUNK) -> Iterator[np.ndarray]:
        """Trigrams of the lower-cased letters, as many arrays as it takes; every run of
        other characters is one space, and the text stands between spaces. None if it
        has no letter. Chunks run into each other, so where they end doesn't matter."""
        text, last = text.lower() + " ", np.array([32], np.int64)
        for k in range(0, len(text), chunk):
            cps = np.frombuffer(text[k : k + chunk].encode("utf-32-le", "surrogatepass"), np.int32)
            for cp in np.unique(cps[~self.known[cps]]).tolist():
                self.known[cp] = True
                self.code[cp] = cp if chr(cp).isalpha() else 32
            c = np.concatenate([last, self.code[cps]])
            c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
            if len(c) > 2:
                yield (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
            last = c[-2:]

    def bundle(self, text: str, chunk: int = CHUNK) -> np.ndarray | None:
        """The sum of the vectors of a text's trigrams; None without a letter."""
        total = None
        for found in self.trigrams(text, chunk):
            grams, n = np.unique(found, return_counts=True)
            for j in range(0, len(grams), 8192):
                part = n[j : j + 8192].astype(np.float32) @ self.vectors(grams[j : j + 8192]).astype(np.float32)
                total = part.astype(np.float64) if total is None else total + part
        return total


def space(dim: int, seed: int) -> Space:
    return hold("langid", (dim, seed), lambda: Space(dim, seed))


@dataclass
class Profiles:
    """Prototype vectors of languages, of length 1."""

    langs: list[str]
    vectors: np.ndarray
    dim: int = DIM
    seed: int = SEED

    def predict(self, text: str) -> tuple[str, float]:
        v = space(self.dim, self.seed).bundle(text) if self.langs else None
        if v is None:
            return UNKNOWN, 0.0
        length = float(np.sqrt(v @ v))
        if not length:
            return self.langs[0], 0.0
        cos = self.vectors @ v / length
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best])))


def fit(docs: DataFrame, dim: int = DIM, seed: int = SEED, mod: int = MOD, fold: int = FOLD) -> Profiles:
    """Bundle all documents with a language and outside the held-out fold. Sums of
    whole numbers don't depend on the order of rows. A task sends one vector for
    each language and batch, summed by dimension before they are shuffled."""

    def run(batches):
        s = space(dim, seed)
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, t in zip(column(b, "lang"), texts(b)):
                if (v := s.bundle(t)) is not None:
                    sums[lang] = sums[lang] + v if lang in sums else v
        langs = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([np.rint(sums[x]).astype(np.int64).tolist() for x in langs], pa.list_(pa.int64()))], ["lang", "v"])

    learn = long_rows(docs).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != fold))
    rows = learn.select("lang", "text").mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()
    langs = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(langs), dim))
    for r in rows:
        vectors[langs.index(r["lang"]), r["pos"]] = r["x"]
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return Profiles(langs, vectors / np.where(norms > 0, norms, 1), dim, seed)


def identify(docs: DataFrame, profiles: Profiles, mod: int = MOD, fold: int = FOLD) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine with the prototype, 0 to 1).

    A null text or one without a letter is `und` with score 0, and so is every
    text if no language was learned. Ties go to the first language by name. A text
    of any length is bundled whole; an empty table gives no rows. Every row is
    judged on its own, so repeated rows give repeated results; a null doc_id is not
    held out. Extra columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for b in slices(batches):
            found = [model.value.predict(t) for t in texts(b)]
            held = [in_fold(i, mod, fold) for i in column(b, "doc_id")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least: float | None = None) -> DataFrame:
    """The rows with a known language and a score of at least `least`, all their
    columns unchanged. By default that is twice the standard deviation that the
    cosine of a prototype with random letters has, one over the root of the
    dimension: a text below it resembles no learned language more than chance would
    have it. Null and empty texts and those without a letter go; rows are judged on
    their own, whatever their doc_id; an empty table gives no rows."""
    if least is None:
        least = 2 / profiles.dim**0.5
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for b in slices(batches):
            found = [model.value.predict(t) for t in texts(b)]
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))

    return long_rows(docs).mapInArrow(run, docs.schema)
