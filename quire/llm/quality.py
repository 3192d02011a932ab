"""Quality classifier: a linear hinge-loss model over Naive Bayes support vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

from .common import Bounded, column, crc_mod, in_fold, long_rows, slices, texts

BITS, MOD, FOLD, THRESHOLD = 18, 5, 0, 0.3
#: At most so many labelled rows of each class are used to fit the model, and of
#: these no more than have so many bytes of indicators together.
SAMPLE, SAMPLE_BYTES = 4_000, 32 << 20
#: Words of a text that are looked at together; a longer text is taken in parts.
PART = 50_000
#: Characters of a word that are looked at together; a longer word is taken in parts.
LONG = 40

_RUN = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_A-ZÀ-ÖØ-Þ]+)|(\d+)|(.)\4*", re.S)


def _shape(word: str) -> str:
    """Letters by case and digits as one mark a run, other characters as they are."""
    return _RUN.sub(lambda m: "A" if m[1] else "a" if m[2] else "9" if m[3] else m[4] * min(len(m[0]), 3), word)


class Features:
    """Indices of the n-gram indicators of a text, without repeats: words, shapes of
    words in runs of one to three, words that follow themselves, and how large a
    share of the text each shape and each repeat has (in powers of two). A word of
    over LONG characters is an indicator as a whole, and its parts count as words."""

    def __init__(self, bits: int = BITS, cached: int = 300_000):
        self.mask = (1 << bits) - 1
        self.words = Bounded(cached, lambda w: (_shape(w), self.index("w" + w.lower())))
        self.grams = Bounded(cached, self.index)
        self.shares = Bounded(50_000, lambda k: self.index(f"s{k[0]}/{k[1]}"))

    def index(self, name) -> int:
        return xxhash.xxh64_intdigest(name if isinstance(name, str) else "g" + "\x00".join(name)) & self.mask

    def of(self, text: str) -> np.ndarray:
        found: set[int] = set()
        counts: dict[str, int] = {}
        same = total = 0
        words = text.split()
        if long := {w for w in words if len(w) > LONG}:
            found.update(self.index("w" + w.lower()) for w in long)
            words = [w[k : k + LONG] for w in words for k in range(0, len(w), LONG)]
        last: list[str] = []
        for k in range(0, len(words), PART):
            part = words[k : k + PART]
            known = [self.words[w] for w in part]
            found.update(i for _, i in known)
            shapes = [s for s, _ in known]
            for s in shapes:
                counts[s] = counts.get(s, 0) + 1
            same += sum(map(str.__eq__, part, part[1:])) + (k > 0 and words[k - 1] == part[0])
            total += len(part)
            shapes = last + shapes  # runs of shapes go on from the part before
            last = shapes[-2:]
            grams = self.grams
            found.update([grams[g] for g in set(zip(shapes, shapes[1:]))])
            found.update([grams[g] for g in set(zip(shapes, shapes[1:], shapes[2:]))])
        for s, n in counts.items():
            found.add(self.shares[s, (total // n).bit_length()])
        if total:
            found.add(self.shares["=", (total // same).bit_length() if same else -1])
        return np.fromiter(found, np.int32, len(found))


_features: dict[int, Features] = {}


def features(bits: int) -> Features:
    if bits not in _features:
        _features[bits] = Features(bits)
    return _features[bits]


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of each indicator's smoothed share in the two classes."""
    counts = []
    for label in (True, False):
        own = [r for r, v in zip(rows, y) if v == label]
        c = smooth + (np.bincount(np.concatenate(own), minlength=size) if own else np.zeros(size))
        counts.append(c / (len(own) + 2 * smooth))
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: np.ndarray, rounds: int = 25, seed: int = 3, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of c * hinge loss, by dual
    coordinate descent: one example's multiplier at a time has a closed form."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0
    sign = np.where(y, 1.0, -1.0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            g = sign[i] * (w[r] @ v + bias) - 1.0
            a = min(max(alpha[i] - g / square[i], 0.0), c[i])
            step = a - alpha[i]
            if step:
                alpha[i] = a
                w[r] += step * sign[i] * v
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by
    Newton steps on smoothed targets."""
    n1, n0 = max(1.0, float((weight * y).sum())), max(1.0, float((weight * ~y).sum()))
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, q = weight * (p - target), weight * p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


@dataclass
class Model:
    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int = BITS

    def margin(self, found: np.ndarray) -> float:
        """Indicators scaled by their log ratios, to length 1, times the weights."""
        if not len(found):
            return self.bias
        v = self.scale[found]
        return float(self.weights[found] @ v) / (float(np.sqrt(v @ v)) or 1.0) + self.bias

    def score(self, text: str) -> float:
        z = self.slope * self.margin(features(self.bits).of(text)) + self.offset
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def chosen(labels: DataFrame, label: str, each: int, mod: int, fold: int) -> tuple[DataFrame, dict[int, int]]:
    """_id, _y of at most `each` labelled documents of each class outside the
    held-out fold, in the order of a hash of doc_id, and how many each class has.
    A document with both labels counts as the larger one."""
    key = F.col("doc_id").cast("long")
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod(key, mod) != fold)
    own = own.groupBy(key.alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    n = {r["_y"]: r["n"] for r in own.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(each) for y in (0, 1)]
    return parts[0].unionAll(parts[1]), n


def gathered(found: DataFrame, most: int = SAMPLE_BYTES) -> list[tuple[int, int, bytes]]:
    """found: id, y, found (binary). Its rows on the driver, ordered: of each class, in
    the order of a hash of the id, as many as have `most` bytes together."""
    held = materialize(found, "features")
    sizes = held.select("id", "y", F.xxhash64("id").alias("h"), F.octet_length("found").alias("n")).orderBy("y", "h", "id", "n").collect()
    total, taken, all_of_them = {0: 0, 1: 0}, [], True
    for r in sizes:
        total[r["y"]] += r["n"]
        if total[r["y"]] <= most:
            taken.append((r["id"],))
        else:
            all_of_them = False
    if not all_of_them:
        held = held.join(F.broadcast(found.sparkSession.createDataFrame(taken, "id long").distinct()), "id", "left_semi")
    return sorted((r["id"], r["y"], bytes(r["found"])) for r in held.collect())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = SAMPLE, bits: int = BITS, mod: int = MOD, fold: int = FOLD, cost: float = 1.0) -> Model:
    """Fit on at most `each` labelled rows of each class, and SAMPLE_BYTES of their
    indicators. Their texts are turned into indicators on the executors; the driver
    gets the indices. One row in four
    is left out of the descent and fits the curve to probabilities. Classes are
    weighted by their true shares there. No labels, or one class only: every text
    gets the share of label 1 (a half without any label)."""
    picked, n = chosen(labels, label, each, mod, fold)

    def run(batches):
        f = features(bits)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.sort(f.of(t)).tobytes() for t in texts(b)], pa.binary())], ["id", "y", "found"])

    sample = long_rows(docs).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")
    got = gathered(sample.mapInArrow(run, "id long, y int, found binary"))
    size = 1 << bits
    y = np.array([r[1] == 1 for r in got], bool)
    if not len(y) or y.all() or not y.any():
        share = n.get(1, 0) / sum(n.values()) if sum(n.values()) else 0.5
        z = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, 1.0, z, bits)
    rows = [np.frombuffer(r[2], np.int32).astype(np.int64) for r in got]
    weight = np.where(y, n[1] / y.sum(), n[0] / (~y).sum())
    order = np.random.default_rng(1).permutation(len(y))
    aside = np.zeros(len(y), bool)
    aside[order[: len(y) // 4]] = True

    def model(use):
        own = [rows[i] for i in np.flatnonzero(use)]
        scale = ratios(own, y[use], size)
        values = []
        for r in own:
            v = scale[r]
            values.append(v / (np.sqrt(v @ v) or 1.0))
        w, bias = dual_descent(own, values, y[use], size, np.full(int(use.sum()), 4 * cost))
        return Model(w.astype(np.float32), scale.astype(np.float32), bias, 1.0, 0.0, bits)

    part = model(~aside) if y[~aside].any() and not y[~aside].all() else model(np.ones(len(y), bool))
    margins = np.array([part.margin(r) for r in rows])
    fair = aside if y[aside].any() and not y[aside].all() else np.ones(len(y), bool)
    part.slope, part.offset = calibrate(margins[fair], y[fair], weight[fair] / weight[fair].mean())
    return part


def score(docs: DataFrame, model: Model, mod: int = MOD, fold: int = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    A null or empty text has no indicators and gets the score of the bias alone; an
    empty table gives no rows; texts of any length are read whole, in parts that run
    into each other. Every row is scored on its own, so repeated rows give repeated
    results and equal texts tie; a null doc_id is not held out. Extra columns, label,
    language and source among them, are never read. The model has a fixed size of
    2^bits weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            s = [m.score(t) for t in texts(b)]
            held = [in_fold(i, mod, fold) for i in column(b, "doc_id")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
