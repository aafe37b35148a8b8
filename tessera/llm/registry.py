"""The queries of this subpackage and their SQL. Operator modules are imported when a query runs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query: module of this subpackage.
MODULES = {
    "op1_lm_scoring": "brown_lm",
    "op2_warc": "warc",
    "op3_html_extraction": "html_extract",
    "op4_chat_formatting": "chat_format",
    "op5_decontamination": "decontaminate",
    "op6_toxicity": "toxicity",
    "op7_url_filters": "url_filter",
    "op8_minhash_dedup": "near_dedup",
    "op9_exact_dedup": "exact_dedup",
    "op10_mixing": "mixing",
    "op11_spelling_variants": "spelling_variants",
    "op12_sharding": "kd_shards",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"tessera.llm.{MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tessera.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
