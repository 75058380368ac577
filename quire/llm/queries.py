"""Queries and SQL of this subpackage, for registration."""

from __future__ import annotations

from quire.llm import byte_bpe, chat, decontaminate, fill_middle, filter_audit, language_id, line_dedup, lm_scoring, ngram_join, pii, quality_rules, sharding, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        ngram_join.op1_ngram_jaccard_join, url_filter.op2_url_filter, language_id.op3_language_id, decontaminate.op4_decontaminate, byte_bpe.op5_byte_bpe,
        chat.op6_chat_format, pii.op7_pii, quality_rules.op8_quality_rules, lm_scoring.op9_lm_scoring, sharding.op10_sharding,
        line_dedup.op11_line_dedup, filter_audit.op12_filter_audit, fill_middle.op13_fill_middle,
    )
}
ORACLE_SQL = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
