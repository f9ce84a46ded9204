"""Queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> (module, function, name of its SQL or None)
_QUERIES = {
    "op6_html_text": ("extraction", "op6_html_text", None),
    "op7_licenses": ("licenses", "op7_licenses", "OP7_SQL"),
    "op4_warc": ("warc", "op4_warc", "OP4_SQL"),
    "op2_toxicity": ("toxicity", "op2_toxicity", None),
    "op1_lm_score": ("ppm", "op1_lm_score", None),
    "op5_near_dedup": ("dedup", "op5_near_dedup", None),
    "op3_bpe": ("bpe", "op3_bpe", None),
    "op10_fingerprint": ("fingerprint", "op10_fingerprint", None),
    "op8_quality": ("quality", "op8_quality", None),
    "op9_mixing": ("mixing", "op9_mixing", "OP9_SQL"),
    "op11_clusters": ("balls", "op11_clusters", "OP11_SQL"),
    "op12_vector_codes": ("codes", "op12_vector_codes", "OP12_SQL"),
    "op13_url_filter": ("urls", "op13_url_filter", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"canopyql.llm.{module}"), function) for name, (module, function, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"canopyql.llm.{module}"), sql) for name, (module, _, sql) in _QUERIES.items() if sql}
