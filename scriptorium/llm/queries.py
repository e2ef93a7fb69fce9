"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op6_cotraining": "cotraining",
    "op2_ngram_trie": "ngram_trie",
    "op3_perspective_rotation": "rotation",
    "op10_toxicity": "toxicity",
    "op4_line_dedup": "line_dedup",
    "op1_decontaminate": "decontaminate",
    "op5_jaccard_join": "jaccard_join",
    "op7_quality_divergence": "quality_rules",
    "op8_token_counts": "token_counts",
    "op9_budget_mix": "mixing",
    "op11_substring_dedup": "substring",
    "op12_lexical_search": "lexical",
    "op13_whitening": "whitening",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
