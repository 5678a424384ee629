"""All queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("secrets_forest", "warc_derivatives", "quality_embeddings", "partenum", "decontamination", "topk_bond", "packing", "phrase_automata", "toxicity_fm", "suffix_levels", "importance_resampling", "whitening", "token_orc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"quillon.llm.{name}").QUERIES
    return out | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quillon.llm.{name}"), "ORACLE_SQL", {})
    return out
