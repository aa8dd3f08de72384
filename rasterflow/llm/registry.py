"""The queries of the training-data operators and their DuckDB forms."""

from . import op1_ngram_jaccard, op2_packing, op3_exact_dedup, op4_warc, op5_html_text, op6_license_scan, op7_mixing, op8_quality_rules, op9_preference_format, op10_secret_scan, op11_exact_topk, op12_source_divergence, op13_vector_codes

_MODULES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_preference_format": op9_preference_format,
    "op10_secret_scan": op10_secret_scan,
    "op11_exact_topk": op11_exact_topk,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
