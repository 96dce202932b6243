"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

#: Query name: (module, function); the modules are imported when a query is asked for.
QUERIES = {
    "op1_suffix_dedup": ("suffix_dedup", "op1_query"),
    "op2_best_fit_packing": ("packing", "op2_query"),
    "op3_quality_rules": ("line_rules", "op3_query"),
    "op4_quality_classifier": ("quality", "op4_query"),
    "op6_topk_search": ("topk", "op6_query"),
    "op7_language_id": ("language", "op7_query"),
    "op10_jaccard_join": ("jaccard", "op10_query"),
    "op5_paragraph_dedup": ("paragraphs", "op5_query"),
    "op9_warc_revisits": ("warc", "op9_query"),
    "op8_mixing": ("mixing", "op8_query"),
    "op11_chat_formatting": ("chat", "op11_query"),
    "op12_whitening": ("whitening", "op12_query"),
    "op13_periodic_runs": ("periodic", "op13_query"),
}

#: Query name: module whose ORACLE_SQL gives its rows.
ORACLES = {"op6_topk_search": "topk", "op9_warc_revisits": "warc", "op11_chat_formatting": "chat"}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), function) for name, (module, function) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__package__}.{module}").ORACLE_SQL for name, module in ORACLES.items()}
