"""Queries and SQL of these operators, by name."""

from __future__ import annotations

from quire.session import table

from . import bpe, decontam, infill, langid, linededup, minhash, negatives, quality, rules, shards, simhash, tokencount, toxicity


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def op1_quality_nbsvm(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, _labels(spark, sf_dir)))


def op2_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op3_shard(spark, sf_dir):
    return shards.shard_documents(_docs(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    return tokencount.token_counts(_docs(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return rules.judge(docs, rules.fit(docs, _labels(spark, sf_dir)))


def op6_decontaminate(spark, sf_dir):
    return decontam.contaminated(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark, sf_dir):
    return linededup.digest(linededup.dedup_lines(_docs(spark, sf_dir)))


def op8_byte_bpe(spark, sf_dir):
    return bpe.round_trip(_docs(spark, sf_dir))


def op9_toxicity(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op10_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op11_superminhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark, sf_dir):
    return infill.digest(infill.transform(_docs(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_nbsvm, op2_simhash_dedup, op3_shard, op4_token_counts, op5_quality_rules, op6_decontaminate, op7_line_dedup, op8_byte_bpe, op9_toxicity, op10_language_id, op11_superminhash_dedup, op12_hard_negatives, op13_fill_in_middle)
}
ORACLES = {"op7_line_dedup": linededup.SQL, "op12_hard_negatives": negatives.SQL, "op13_fill_in_middle": infill.SQL}
