import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_tokens_encode_to_themselves():
    c = bpe.codec(PATH, PATTERN)
    assert all(c.fst.encode(t) == [i] for t, i in list(c.fst.ranks.items())[::37])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeiotnshr =\n", max_size=200), st.text("a=", max_size=300)))
def test_same_ids_as_the_library(reference, text):
    c = bpe.codec(PATH, PATTERN)
    ids = c.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert c.decode(ids) == text


def test_other_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c = bpe.codec(path, PATTERN)
    for text in ("Überraschung, niños! 日本語", "aaaaaaaaaaaaab", " x  y\n\n z"):
        assert c.encode(text) == other.encode_ordinary(text)


@given(st.text(max_size=30), st.integers(1, 5))
def test_utf8_stream(text, size):
    raw, machine = text.encode(), bpe.Utf8Stream()
    out = "".join(machine.feed(raw[k : k + size]) for k in range(0, len(raw), size)) + machine.finish()
    assert out == text


def test_utf8_stream_keeps_little_and_marks_errors():
    machine = bpe.Utf8Stream()
    assert machine.feed("a😀".encode()[:4]) == "a" and len(machine.kept) == 3
    assert machine.finish() == "�"


def test_states_stay_bounded():
    ranks = bpe.read_ranks(PATH)
    small = bpe.MergeTransducer(ranks, max_states=50)
    words = [f"hello{k}world".encode() for k in range(50)]
    whole = bpe.codec(PATH, PATTERN).fst
    assert all(small.encode(w) == whole.encode(w) for w in words)
    assert len(small.states) < 200
    # also within one pre-token, whose earlier cuts live on from table to table
    data = "".join(f"{k}ß{k * k}x".replace("1", "aé") for k in range(3000)).encode()
    assert small.encode(data) == whole.encode(data)
    assert len(small.states) <= 27 and len(small.moves) <= 26 * 3


def test_round_trip_of_edge_cases(reference, sample, nothing):
    assert bpe.round_trip(nothing).count() == 0
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(sample).collect())
    want = []
    for r in sample.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_tokenize_and_back(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    back = {r.doc_id: r.text for r in bpe.detokenize(bpe.tokenize(documents)).collect()}
    assert back == texts
