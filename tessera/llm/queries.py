"""Queries of the training-data operators, and their oracles where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, imatch, langid, neardup, pieces, preference, quality, tokencount, toxicity, warc

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_warc_fixity": warc.op4_warc_fixity,
    "op5_preference_formatting": preference.op5_preference_formatting,
    "op6_ngram_jaccard_join": neardup.op6_ngram_jaccard_join,
    "op7_language_id": langid.op7_language_id,
    "op8_document_fingerprints": imatch.op8_document_fingerprints,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op4_warc_fixity": warc.SQL, "op5_preference_formatting": preference.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
