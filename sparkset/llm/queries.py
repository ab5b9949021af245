"""Registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from sparkset.llm import bpe, decontaminate, html_text, licenses, line_dedup, quality_knn, quality_rules, simhash, suffixes, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_main_text": html_text.op5_main_text,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_quality_knn": quality_knn.op7_quality_knn,
    "op8_suffix_repeats": suffixes.op8_suffix_repeats,
    "op9_bpe_roundtrip": bpe.op9_bpe_roundtrip,
    "op10_simhash_components": simhash.op10_simhash_components,
}

#: DuckDB SQL of the same rows. The other operators can't be expressed in SQL and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_license_scan": licenses.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op8_suffix_repeats": suffixes.ORACLE,
}
