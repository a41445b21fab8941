"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from maskwell.llm import class_lm, embedding_dedup, html_extract, importance, language_id, mixing, ngram_join, packing, quality_rules, sharding

_QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": importance.op2_quality_classifier,
    "op3_packing": packing.op3_packing,
    "op4_class_lm": class_lm.op4_class_lm,
    "op5_mixing": mixing.op5_mixing,
    "op6_sharding": sharding.op6_sharding,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_language_id": language_id.op8_language_id,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_html_extraction": html_extract.op10_html_extraction,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {**quality_rules.SQL, **sharding.SQL, **ngram_join.SQL, **embedding_dedup.SQL}
