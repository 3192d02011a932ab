import hashlib
import os

import corpus_pipeline
import public_tokenizers
import tiktoken

from quire.llm import bpe, decontam, langid
from quire.llm.registry import ORACLES, QUERIES
from quire.session import shared_dir
from test_resemblance import survivors


def dropped_lines(rows):
    from collections import defaultdict

    from quire.llm.common import WHITE
    from test_linededup import lower

    docs = defaultdict(set)
    key = lambda x: lower(x.strip(WHITE))
    for i, t in rows:
        for x in t.split("\n"):
            docs[key(x)].add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 40 or len(docs[key(x)]) < 5 or max(docs[key(x)]) == i)) for i, t in rows]


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.fit(docs)
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if model.predict(r.text or "")[1] >= 2 / model.dim**0.5)
    rows = dropped_lines(rows)
    rows = survivors(rows)
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    joined = [f" {' '.join(x)} " for x in items]
    rows = [(i, t) for i, t in rows if not any(x in f" {' '.join(decontam.words(t))} " for x in joined)]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()[0]), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert got[i].n_tokens == len(enc.encode_ordinary(t)) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_on_edge_cases(spark, sample, nothing):
    d = "/root/testdata/sf0.001"
    for docs in (nothing, sample):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, d).collect(), stage(spark, docs, d).schema)
            assert docs.columns == before or name == "tokens"
    assert docs.count() > 0


def test_clashing_columns_and_released_tables(spark, sample, tmp_path):
    d = tmp_path / "sf"
    odd = sample.selectExpr("*", "'a' as n_lines", "'b' as n_dropped", "'c' as _keys", "'d' as _id", "'e' as _h", "'f' as set")
    odd.write.parquet(str(d / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(d / "benchmark.parquet"))
    before = set(shared(spark))
    out = corpus_pipeline.run(spark, str(d))
    assert out.count() > 0 and len(set(shared(spark)) - before) == 1


def shared(spark):
    return os.listdir(shared_dir(spark).removeprefix("file://"))


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
