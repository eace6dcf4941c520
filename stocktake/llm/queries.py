"""The registry of this subpackage: queries and the SQL that checks them."""

from __future__ import annotations

import importlib

#: Module -> query function in it.
QUERIES = {
    "token_counts": "op1_token_counts",
    "decontamination": "op2_decontamination",
    "pii": "op3_pii",
    "quality_rules": "op4_quality_rules",
    "mixing": "op5_mixing",
    "quality_classifier": "op6_quality_classifier",
    "license_scan": "op7_license_scan",
    "jaccard_join": "op9_jaccard_join",
    "lm_scoring": "op8_lm_scoring",
    "url_filter": "op10_url_filter",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"stocktake.llm.{module}"), name) for module, name in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in QUERIES.items():
        sql = getattr(importlib.import_module(f"stocktake.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
