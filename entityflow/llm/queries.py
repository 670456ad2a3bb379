"""The queries of this subpackage: opN_<name> over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_decontaminate, q_lang_id, q_licenses, q_media, q_minhash, q_mixing, q_paragraphs, q_secrets, q_toxicity, q_url_filter

_MODULES = [q_lang_id, q_decontaminate, q_minhash, q_url_filter, q_media, q_licenses, q_paragraphs, q_secrets, q_toxicity, q_mixing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
