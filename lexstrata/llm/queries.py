"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import bpe, collocations, decontaminate, html_text, language_model, mixing, near_dedup, quality_rules, substring_dedup, suffix_dedup, url_filter, vector_codes, warc

QUERIES = {
    "op1_html_extraction": html_text.query,
    "op2_source_mixing": mixing.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_quality_rules": quality_rules.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_minhash_near_dedup": near_dedup.query,
    "op7_suffix_array_dedup": suffix_dedup.query,
    "op8_url_filters": url_filter.query,
    "op9_quality_classifier": language_model.query,
    "op10_warc": warc.query,
    "op11_vector_codes": vector_codes.query,
    "op12_bpe_automaton": bpe.query,
    "op13_collocations": collocations.query,
}
ORACLES = {
    "op1_html_extraction": html_text.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op7_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op8_url_filters": url_filter.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
