"""The queries of this subpackage: name -> callable(spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, embedding_dedup, html_extraction, language_id, ngram_join, packing, phrase_mining, pii, quality, sentencepiece_codec, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op4_sentencepiece": sentencepiece_codec.op4,
    "op7_html_extraction": html_extraction.op7,
    "op1_benchmark_decontamination": decontamination.op1,
    "op2_pii_pseudonyms": pii.op2,
    "op3_embedding_near_dedup": embedding_dedup.op3,
    "op8_language_id": language_id.op8,
    "op9_quality_classifier": quality.op9,
    "op5_toxicity": toxicity.op5,
    "op6_ngram_jaccard": ngram_join.op6,
    "op10_suffix_array_dedup": suffix_dedup.op10,
    "op11_best_fit_packing": packing.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_phrase_collocations": phrase_mining.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": embedding_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_phrase_collocations": phrase_mining.ORACLE,
}
