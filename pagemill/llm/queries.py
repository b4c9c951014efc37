"""Queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pagemill.llm import (
    decontaminate,
    lexical_search,
    licenses,
    lm_scoring,
    mixing,
    pii,
    quality_crf,
    quality_rules,
    similarity_join,
    token_counts,
    vector_search,
    warc,
    whitening,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pii": pii.op4_pii,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_jaccard_join": similarity_join.op6_jaccard_join,
    "op7_warc": warc.op7_warc,
    "op8_quality_crf": quality_crf.op8_quality_crf,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_vector_search": vector_search.op11_vector_search,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLE_SQL = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_jaccard_join": similarity_join.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_vector_search": vector_search.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
