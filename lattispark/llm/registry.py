"""Queries of the text operators and the DuckDB SQL of those that SQL can express."""

import corpus_pipeline

from . import bpe, fingerprint, mix, ngram_join, quality, rules, secrets, substrings, toxicity, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_mix_sources": mix.op2_mix_sources,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_warc": warc.op9_warc,
    "op10_fingerprints": fingerprint.op10_fingerprints,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_quality_rules": rules.OP3_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op8_ngram_jaccard": ngram_join.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
