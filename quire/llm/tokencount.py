"""Token counts by dynamic programming shared over a trie of pre-tokens."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows, slices, texts

SPACE = "▁"
#: Words of a worker's count table; it starts anew when full.
CACHED = 600_000
#: The trie has so many characters of a word; what follows is scored from its last
#: node on, in parts.
LONG, PART = 64, 4_096


class Unigram:
    """Pieces with log probabilities, and one more token for each UTF-8 byte of a
    character that no piece covers.

    The vocabulary file orders pieces by rank but has no frequencies, so by
    default the piece of rank r has the probability that Zipf's law gives it,
    1 / ((r + 1) * H), H the harmonic number of the vocabulary's size. A byte
    token costs `penalty` more than the rarest piece."""

    def __init__(self, pieces: list[str], scores: list[float] | None = None, penalty: float = 10.0):
        h = math.log(len(pieces)) + 0.5772156649 if pieces else 1.0
        self.score = dict(zip(pieces, scores or [-math.log((r + 1) * h) for r in range(len(pieces))]))
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(self.score.values(), default=0.0) - penalty

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in ids])

    def extend(self, text: str, forward: list[float], count: list[int]) -> None:
        """Forward scores of all prefixes of text, from the first that `forward`
        lacks. forward[i] is the best log probability of the first i characters,
        count[i] the number of tokens on that path; of equal paths the one with
        the shorter last piece is taken."""
        score, longest = self.score, self.longest
        for i in range(len(forward), len(text) + 1):
            n = len(text[i - 1].encode())
            best, tokens = forward[i - 1] + n * self.byte, count[i - 1] + n
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                s = score.get(text[j:i])
                if s is not None and forward[j] + s > best:
                    best, tokens = forward[j] + s, count[j] + 1
            forward.append(best)
            count.append(tokens)

    def count(self, word: str, forward: tuple = (0.0,), count: tuple = (0,), before: str = "") -> int:
        """Tokens of a word that `before`, with these forward scores and counts, stands
        in front of. No more is held than a part and the longest piece."""
        forward, count = list(forward), list(count)
        for k in range(0, len(word), PART):
            text = before + word[k : k + PART]
            self.extend(text, forward, count)
            before, forward, count = text[-self.longest :], forward[-self.longest - 1 :], count[-self.longest - 1 :]
        return count[-1]


class Trie:
    """Distinct pre-tokens, character by character; a node holds the forward score
    and the token count of its prefix, so a prefix that many words share is scored
    once. A word's count is what its last node holds; a word of over LONG characters
    goes on from there by itself."""

    def __init__(self, model: Unigram):
        self.model, self.child = model, {}

    def insert(self, word: str) -> None:
        node = self.child
        for c in word[:LONG]:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(word[LONG:])

    def fill(self) -> dict[str, int]:
        """Walk the trie depth first, with one stack of forward scores for the path
        from the root, and give the counts of all words in it."""
        out: dict[str, int] = {}
        forward, count, path = [0.0], [0], []
        extend = self.model.extend
        stack = [iter(self.child.items())]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                    forward.pop()
                    count.pop()
                continue
            c, below = step
            if not c:
                word, n = "".join(path), self.model.longest
                for rest in below:
                    out[word + rest] = self.model.count(rest, forward[-n - 1 :], count[-n - 1 :], word[-n:]) if rest else count[-1]
                continue
            path.append(c)
            extend("".join(path), forward, count)
            stack.append(iter(below.items()))
        return out


def count_words(model: Unigram, words: set[str]) -> dict[str, int]:
    trie = Trie(model)
    for w in words:
        trie.insert(w)
    return trie.fill()


_models: dict[str, tuple[Unigram, dict[str, int]]] = {}


def _model(path: str) -> tuple[Unigram, dict[str, int]]:
    if path not in _models:
        _models[path] = Unigram.load(path), {}
    return _models[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, slice_rows: int = 500) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Pre-tokens are the words between white space (as str.split() has it), each
    with a mark before it for the space. The distinct ones of a slice of rows that
    have no count yet go into a trie together. A null or empty text has no words
    and no tokens; texts and words of any length are counted whole; an empty table
    gives no rows. Of equally likely segmentations the one with the shorter last
    piece counts. Every row is counted on its own: repeated rows give repeated
    results, a null doc_id stays null, extra columns are ignored. Nothing is
    shuffled; a worker's tables have a bounded size."""
    path = path or default_vocabulary()

    def run(batches):
        model, known = _model(path)
        for b in slices(batches, slice_rows):
            split = [t.split() for t in texts(b)]
            new = {w for ws in split for w in ws}.difference(known)
            long = {w for w in new if len(w) > LONG}
            if len(known) + len(new) > CACHED:
                known.clear()
                new = {w for ws in split for w in ws}
                long = {w for w in new if len(w) > LONG}
            counts = count_words(model, {SPACE + w for w in new})
            known.update((w[1:], n) for w, n in counts.items())
            n_words = [len(ws) for ws in split]
            n_tokens = [sum(map(known.__getitem__, ws)) for ws in split]
            for w in long:
                del known[w]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
