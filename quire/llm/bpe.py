"""Byte-level BPE by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Bounded, Recent, column, hold, long_rows, slices, texts

#: Pre-tokens longer than that go through the transducer each time instead of the cache.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeTransducer:
    """Merges compiled to a finite-state transducer over bytes.

    A prefix of a pre-token has one BPE encoding, and a sequence of tokens is an
    encoding exactly if each adjacent pair of tokens stays a pair when their
    joined bytes are merged from scratch. A state holds, for every earlier cut
    that a token still being read may start from, the place in the token trie and
    the last token before the cut. A move names the cuts that stay, the cut that a
    token ends from and that token. Each cut has a register with its tokens not yet
    emitted; what all registers agree on is emitted, so lookahead is bounded by the
    longest token. States and moves are made when first met and kept in tables of
    two generations: when the young one has half of the states or moves allowed it
    becomes the old one, and what is met again moves back, with the state that it
    leads to. A cut is one number, node << 32 | last token + 1."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0, max_states: int = 200_000, max_moves: int = 1_500_000):
        max_states, max_moves = int(max_states * share), int(max_moves * share)
        self.ranks, self.max_states, self.max_moves = ranks, max_states, max_moves
        self.token = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        for t, i in ranks.items():
            node = 0
            for b in t:
                self.inner[node] = True
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = after
            self.ends[node] = i
        self.pairs = Bounded(int(300_000 * share), self._stays)
        self.stays: dict[tuple, tuple] = {}
        self.made, self.states, self.number, self.moves = 0, {}, {}, {}
        self._turn()

    def _turn(self) -> None:
        """The young generation becomes the old one."""
        start = (0,)
        self.old_states, self.old_number, self.old_moves = self.states, self.number, self.moves
        self.states: dict[int, tuple] = {0: start}
        self.number: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[int, tuple, int, int]] = {}

    def _stays(self, pair: int) -> bool:
        """Whether merging the joined bytes of two tokens (the first in the upper 32
        bits) gives these two back."""
        left, right = self.token[pair >> 32], self.token[pair & 0xFFFFFFFF]
        data, cut = left + right, len(left)
        edges = list(range(len(data) + 1))
        while len(edges) > 3:
            best, at = None, 0
            for k in range(len(edges) - 2):
                r = self.ranks.get(data[edges[k] : edges[k + 2]])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None or edges[at + 1] == cut:
                return False
            del edges[at + 1]
        return edges[1] == cut and data not in self.ranks

    def _keep(self, state: int) -> None:
        """The state is in the young generation."""
        if state not in self.states:
            cuts = self.states[state] = self.old_states[state]
            self.number[cuts] = state

    def _move(self, state: int, byte: int) -> tuple[int, tuple, int, int]:
        if 2 * len(self.states) > self.max_states or 2 * len(self.moves) > self.max_moves:
            self._turn()
            self._keep(state)
        move = self.old_moves.get(state << 8 | byte)
        if move is None:
            move = self._new_move(state, byte)
        else:
            self._keep(move[0])
        self.moves[state << 8 | byte] = move
        return move

    def _new_move(self, state: int, byte: int) -> tuple[int, tuple, int, int]:
        live, stay, source, token = [], [], -1, -1
        for k, cut in enumerate(self.states[state]):
            after = self.child.get(cut >> 32 << 8 | byte)
            if after is None:
                continue
            t, last = self.ends[after], (cut & 0xFFFFFFFF) - 1
            if t >= 0 and source < 0 and (last < 0 or self.pairs[last << 32 | t]):
                source, token = k, t
            if self.inner[after]:
                live.append(after << 32 | last + 1)
                stay.append(k)
        if source < 0:
            raise ValueError("these ranks have no token for some byte or some merge")
        after = (*live, token + 1)
        number = self.number.get(after)
        if number is None:
            number = self.old_number.get(after)
            if number is None:
                self.made = number = self.made + 1
                self.states[number] = after
                self.number[after] = number
            else:
                self._keep(number)
        stay = tuple(stay)
        return number, self.stays.setdefault(stay, stay), source, token

    def encode(self, data: bytes) -> list[int]:
        state, out, held, moves = 0, [], [()], self.moves
        for b in data:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self._move(state, b)
                moves = self.moves
            state, stay, source, token = move
            newest = (*held[source], token)
            if not stay:
                out += newest
                held = [()]
                continue
            held = [held[k] for k in stay]
            held.append(newest)
            if len(newest) > 32:
                agreed = 0
                for same in zip(*held):
                    if same.count(same[0]) != len(same):
                        break
                    agreed += 1
                out += newest[:agreed]
                held = [h[agreed:] for h in held]
        out += held[-1]
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding: feed() returns the characters that are complete
    and keeps at most three bytes; what can't be UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.kept = b""

    def feed(self, chunk: bytes) -> str:
        data = self.kept + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.kept = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.kept = self.kept.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Texts to ids and back. Pre-tokens are matches of `pattern`. share: of the usual
    size of the tables that it fills; smaller ones take less memory and more time."""

    def __init__(self, path: str, pattern: str, share: float = 1.0):
        ranks = read_ranks(path)
        self.fst = MergeTransducer(ranks, share)
        self.split = regex.compile(pattern)
        self.packed = Recent(int(600_000 * share), self._pack)
        tokens = [self.fst.token.get(i) for i in range(max(ranks.values()) + 1)]
        self.token = np.array(tokens, dtype=object)

    def _pack(self, word: str) -> bytes:
        ids = self.fst.encode(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([packed[w] if len(w) <= LONG else self._pack(w) for w in self.split.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_stream(self, ids: np.ndarray, chunk: int = 16_384) -> Iterator[str]:
        machine = Utf8Stream()
        for k in range(0, len(ids), chunk):
            part = ids[k : k + chunk]
            yield machine.feed(b"".join(self.token[part].tolist()))
        yield machine.finish()

    def decode(self, ids) -> str:
        return "".join(self.decode_stream(np.asarray(ids, dtype="<u4")))


def codec(path: str, pattern: str, share: float = 1.0) -> Codec:
    """One codec for each vocabulary and Python process: the tables that it fills
    serve all tasks of the process."""
    return hold("bpe", (path, pattern, share), lambda: Codec(path, pattern, share))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenize(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the byte-level BPE encoding of every whole text.

    A null or empty text has no ids. Each row is encoded on its own, so repeated
    rows give repeated results; a null doc_id stays null. Other columns are
    ignored, whatever their names. Nothing is shuffled."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([c.encode(t) for t in texts(b)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return long_rows(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def detokenize(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give the empty text."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([c.decode(i or []) for i in column(b, "ids")], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, share: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text is encoded,
    the ids are decoded again, and both are returned as digests.

    A null text is the empty text (no tokens). Texts of any length are taken whole.
    Ties can't arise: ranks are unique. Repeated rows give repeated results. Empty
    table: no rows. Extra columns are ignored. share: see Codec; it changes no result."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    def run(batches):
        c = codec(path, pattern, share)
        for b in slices(batches):
            n, ids, back = [], [], []
            for t in texts(b):
                packed = c.encode_packed(t)
                n.append(len(packed) >> 2)
                ids.append(hashlib.sha256(packed).hexdigest())
                digest = hashlib.sha256()
                for piece in c.decode_stream(np.frombuffer(packed, dtype="<u4")):
                    digest.update(piece.encode())
                back.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return long_rows(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
