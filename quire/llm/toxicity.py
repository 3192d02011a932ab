"""Toxicity: noisy-channel restoring of disguised words, then a linear score."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, column, hold, in_fold, long_rows, slices, texts
from .quality import chosen, gathered

MOD, FOLD, THRESHOLD = 5, 0, 0.5
#: At most so many labelled rows of each class are used to fit the score.
SAMPLE = 3_000
#: Longer tokens are decoded each time and not kept.
LONG = 64
#: The score reads prefixes of words of these lengths, and whole words.
PREFIXES = range(4, 9)

#: Letters that a character may stand for.
DISGUISES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "§": "s", "*": "aeiou",
}
#: Letters of other scripts that look like Latin ones.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "к": "k", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "т": "t", "м": "m", "н": "h", "в": "b", "д": "d", "п": "n", "г": "r", "и": "u", "ш": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u",
}
#: Log probabilities of the channel: a letter stands for itself; is disguised; is
#: said again; something is put between letters.
PLAIN, DISGUISED, AGAIN, BETWEEN = 0.0, math.log(0.02), math.log(0.2), math.log(0.05)

#: Letters of the character model: a word's edge, a-z, and the lower-case letters
#: of Latin-1; every other letter is one class.
ALPHABET = "\x00abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
N = len(ALPHABET) + 1
_PLACE = {c: k for k, c in enumerate(ALPHABET)}
_WORD = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_ALIKE = str.maketrans(ALIKE)
#: Mean log probability of a letter from which on a reading of figures may be a word (93 of
#: 100 numbers read less likely, but so do words whose letters are rare together).
NUMBER = -4.0
_EDGE = ".,;:!?\"'()[]{}<>…“”„«»-–—_*#%&~`=/\\^"
#: Signs at the edge of a token that stand for no letter.
_CLEAR = "".join(c for c in _EDGE if c not in DISGUISES)


def letter_classes() -> np.ndarray:
    """The class of each code point of the basic plane: letters as above, the edge
    (0) for all that is no letter."""
    out = np.zeros(0x10000, np.int64)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = _PLACE.get(c, N - 1)
    return out


def plain_letters(token: str) -> str:
    """A token with compatibility forms as plain characters; in one that mixes scripts,
    Latin letters and such as look like them, all Latin. Words of another script stay."""
    if token.isascii() or max(token) < "\u0180":  # Latin letters, accents and all
        return token
    folded = unicodedata.normalize("NFKC", token)
    lower = folded.lower()
    seen = lower.translate(_ALIKE)
    mixed = seen != lower and any(c in _PLACE for c in lower if c.isalpha()) and all(c in _PLACE for c in seen if c.isalpha())
    return seen if mixed else folded


def _one_letter(token: str) -> str:
    """The letter or sign that a token consists of, but for what stands at its edges."""
    plain = plain_letters(token)
    return next((c for c in (plain.strip(_EDGE), plain.strip(_CLEAR), plain) if len(c) == 1), "")


@dataclass
class CharModel:
    """Log probability of a letter after two others, from counts of the corpus."""

    logp: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, smooth: float = 0.1) -> CharModel:
        three = counts.reshape(N, N, N).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + smooth) / (one.sum() + smooth * N)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        return cls(np.log(p3))


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams of words, each between two edges, over all
    documents. A task adds up its own; there are no more sums than trigrams."""

    def run(batches):
        classes, total, held, size = letter_classes(), np.zeros(N**3, np.int64), [], 0
        for b in slices(batches):
            for t in texts(b):
                cps = np.frombuffer(t.lower().encode("utf-32-le"), np.uint32)
                c = np.concatenate([[0, 0], classes[np.minimum(cps, 0xFFFF)], [0, 0]])
                # after an edge stands another one: words don't see the word before
                key = (np.where(c[1:-1] > 0, c[:-2], 0) * N + c[1:-1]) * N + c[2:]
                held.append(key[(c[1:-1] > 0) | (c[2:] > 0)])
                size += len(key)
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=N**3)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["key", "n"])

    out = np.zeros(N**3, np.int64)
    for r in long_rows(docs).select("text").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r["key"]] = r["n"]
    return out


class Short(Bounded):
    """A cache that keeps nothing of long tokens."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= LONG else self.make(key)


class Restorer:
    """Disguised words back to letters.

    A token's characters make a lattice: a letter stands for itself, a figure or
    sign for the letters it looks like, or it was put between letters, and a letter
    said again may be one letter. Viterbi finds the path that channel and character
    model together make most likely. A state is the last two letters; a path is kept
    as its last letter and the path before. Letters said more than three times in a
    row are read as three: no word has more."""

    def __init__(self, model: CharModel, cached: int = 200_000):
        self.logp = model.logp
        self.decoded = Short(cached, self._decode)
        self.known = Short(cached, self._parts)
        self.spaced = Short(cached, lambda t: self._decode(t, breaks=True))
        self.single = Bounded(cached, _one_letter)

    def likely(self, word: str) -> float:
        """The mean log probability of a word's letters and its end."""
        a = b = 0
        total = 0.0
        for c in [*word, "\x00"]:
            k = _PLACE.get(c, N - 1)
            total += float(self.logp[a, b, k])
            a, b = b, k
        return total / (len(word) + 1)

    def _decode(self, token: str, breaks: bool = False) -> str:
        """The likeliest reading. Where a token has no letter, its signs that look like
        letters are read and not passed over. breaks: words may end between signs."""
        logp, place = self.logp, _PLACE
        token = _RUN.sub(r"\1\1\1", token)
        bare = not any(map(str.isalpha, token))
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for c in token:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}

            def offer(key, s, path):
                if key not in after or s > after[key][0]:
                    after[key] = s, path

            letter = c.isalpha()
            readings = ((c, PLAIN),) if letter else tuple((x, DISGUISED) for x in DISGUISES.get(c, ""))
            for (a, b), (s, path) in states.items():
                end = s + float(logp[a, b, 0])
                for x, cost in readings:
                    k = place.get(x, N - 1)
                    offer((b, k), s + cost + float(logp[a, b, k]), (x, path))
                    if breaks and path:
                        offer((0, k), end + cost + float(logp[0, 0, k]), (x, (" ", path)))
                if letter and path and path[0] == c:
                    offer((a, b), s + AGAIN, path)
                if not letter and not (bare and readings):
                    offer((a, b), s + BETWEEN, path)
            states = after
        path = max(((s + float(logp[a, b, 0]), path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def _parts(self, token: str) -> tuple[str, ...]:
        """The words of a white-space token, lower-case; disguised ones restored
        beside what they show. Only letters, none of them said twice in a row, have
        one reading: themselves. Asterisks alone say no letter, nor does a number whose
        reading is no likely word. A token in look-alikes or compatibility forms is read
        as the plain letters, too."""
        seen = plain_letters(token)
        if seen != token:
            return (*self._parts(seen), *_WORD.findall(token.lower()))
        core, kept = token.strip(_EDGE).lower(), token.strip(_CLEAR).lower()
        if kept.isalpha() and not _TWICE.search(kept):
            return (kept,)
        shown = (core,) if core.isalpha() else tuple(_WORD.findall(core))
        if not kept.strip("*"):
            return shown
        if (figures := kept.strip(_EDGE)).isnumeric():
            # a number, unless its reading looks like a word
            read = self.decoded[figures] if 3 <= len(figures) <= LONG else ""
            return (*shown, read) if read and self.likely(read) >= NUMBER else shown
        return (*shown, self.decoded[kept])

    def parts(self, token: str) -> tuple[str, ...]:
        return self.known[token]

    def words(self, text: str) -> set[str]:
        """The distinct words of a text. Three single letters or more in a row, with or
        without punctuation, are read as one spaced word too, and as several."""
        tokens = text.split()
        out: set[str] = set()
        single = {}
        known = self.known
        for t in set(tokens):
            out.update(known[t])
            if c := self.single[t]:
                single[t] = c
        if single:
            out |= self.apart(tokens, single)
        out.discard("")
        return out

    def apart(self, tokens: list[str], single: dict[str, str]) -> set[str]:
        """Words of runs of tokens that `single` has a letter for."""
        out: set[str] = set()
        run: list[str] = []
        for t in [*tokens, ""]:
            if c := single.get(t):
                run.append(c)
            else:
                spaced = "".join(run).lower()
                if len(run) >= 3 and spaced.strip("*") and not spaced.isnumeric():
                    out.add(self.decoded[spaced])
                    out.update(self.spaced[spaced].split())
                run = []
        return out


def names(word: str) -> list[int]:
    """Hashes of a word and its prefixes."""
    h = xxhash.xxh64_intdigest
    return [h("w" + word) >> 1] + [h("p" + word[:k]) >> 1 for k in PREFIXES if len(word) >= k]


@dataclass
class Model:
    chars: CharModel
    weights: dict[int, float]
    bias: float
    #: By which a Python process knows the tables that it has filled with this model.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scorer(self):
        """A function from text to score, with tables of its own."""
        restorer, weights = Restorer(self.chars), self.weights
        useful = lambda words: tuple(k for w in words if w for k in names(w) if k in weights)
        # of a token what counts, and its letter if it has but one
        known = Short(400_000, lambda t: (useful(restorer._parts(t)), restorer.single[t]))

        def score(text: str) -> float:
            found: set[int] = set()
            tokens, single = text.split(), {}
            for t in set(tokens):
                hit, c = known[t]
                if hit:
                    found.update(hit)
                if c:
                    single[t] = c
            if single:
                found.update(useful(restorer.apart(tokens, single)))
            z = self.bias + sum(weights[k] for k in sorted(found))
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

        return score


def _telling(rows: list[np.ndarray], y: np.ndarray, most: int = 2_000, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The features whose share differs most between the classes, in standard
    deviations: at least three. Second, those of them that speak for label 1."""
    keys, n = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.int64), np.empty(0, int))
    hits, n1 = np.unique(np.concatenate([r for r, v in zip(rows, y) if v]), return_counts=True)
    pos = np.zeros(len(keys))
    pos[np.searchsorted(keys, hits)] = n1
    share = y.mean()
    z = (pos - n * share) / np.sqrt(n * share * (1 - share) * np.maximum(1e-9, 1 - n / len(y)) + 0.25)
    good = np.flatnonzero((np.abs(z) >= 3) & (n >= least))
    best = good[np.lexsort((keys[good], -np.abs(z[good])))][:most]
    return keys[best], keys[best[z[best] > 0]]


def _logistic(rows: list[np.ndarray], y: np.ndarray, keys: np.ndarray, l1: float = 0.0005, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Sparse logistic regression over indicators by accelerated proximal steps. The
    indicators are kept as pairs of row and column; the step follows from the
    largest singular value, found by power iteration."""
    order = np.argsort(keys)
    ranked = keys[order]
    i = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found = np.concatenate(rows)
    at = np.minimum(np.searchsorted(ranked, found), max(0, len(keys) - 1))
    hit = ranked[at] == found if len(keys) else np.zeros(len(found), bool)
    i, j = i[hit], order[at[hit]] if len(keys) else at[hit]
    times = lambda v: np.bincount(i, v[j], minlength=len(rows))
    back = lambda v: np.bincount(j, v[i], minlength=len(keys))
    u = np.ones(len(keys))
    for _ in range(30 if len(keys) else 0):
        u = back(times(u))
        u /= np.sqrt(u @ u) or 1.0
    largest = float(times(u) @ times(u)) if len(keys) else 0.0
    w, b = np.zeros(len(keys)), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (1.2 * largest / len(y) + 1)
    for _ in range(rounds if len(keys) else 0):
        p = 1 / (1 + np.exp(-np.clip(times(v) + c, -30, 30)))
        g = p - y
        w2 = v - step * back(g) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * l1, 0)
        b2 = c - step * float(g.mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = SAMPLE, mod: int = MOD, fold: int = FOLD) -> Model:
    """The character model from all documents, the score from at most `each`
    labelled rows of each class outside the held-out fold, and quality.SAMPLE_BYTES
    of their features. The driver gets hashes of the sample's words and prefixes, no
    texts. The intercept is moved from the
    sample's shares of the classes to the true ones. No labels, or one class only:
    every text gets the share of label 1 (a half without any label)."""
    chars = CharModel.of(character_counts(docs))
    picked, n = chosen(labels, label, each, mod, fold)
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def run(batches):
        restorer = Restorer(shared.value)
        for b in slices(batches):
            found = [np.unique(np.array([k for w in restorer.words(t) for k in names(w)], np.int64)).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "y", "found"])

    sample = long_rows(docs).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")
    got = gathered(sample.mapInArrow(run, "id long, y int, found binary"))
    y = np.array([r[1] == 1 for r in got], bool)
    if not len(y) or y.all() or not y.any():
        share = n.get(1, 0) / sum(n.values()) if sum(n.values()) else 0.5
        return Model(chars, {}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    rows = [np.frombuffer(r[2], np.int64) for r in got]
    keys, positive = _telling(rows, y)
    # what tells the classes apart among texts that hold a suspect word: its harmless uses
    suspect = np.array([bool(len(r)) and bool(np.isin(r, positive).any()) for r in rows]) if len(positive) else np.zeros(len(y), bool)
    if y[suspect].any() and not y[suspect].all():
        keys = np.unique(np.concatenate([keys, _telling([r for r, k in zip(rows, suspect) if k], y[suspect])[0]]))
    w, b = _logistic(rows, y.astype(float), keys)
    b += math.log(n[1] / n[0]) - math.log(y.sum() / (~y).sum())
    return Model(chars, {int(k): float(x) for k, x in zip(keys, w) if x}, b)


def score(docs: DataFrame, model: Model, mod: int = MOD, fold: int = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    A null or empty text has no words and gets the score of the intercept alone; an
    empty table gives no rows; texts and tokens of any length are decoded whole, in
    time in proportion. Of equally likely readings the first found counts. Every row
    is scored on its own, so repeated rows give repeated results; a null doc_id is
    not held out. Extra columns, label, language and source among them,
    are never read. The model has a few thousand weights at most and a table of
    letter trigrams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = hold("toxicity", shared.value.key, shared.value.scorer)
        for b in slices(batches):
            s = [of(t) for t in texts(b)]
            held = [in_fold(i, mod, fold) for i in column(b, "doc_id")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
