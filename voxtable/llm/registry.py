"""Queries of the corpus operators, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("quality", "language", "line_dedup", "mixing", "simhash", "decontamination", "fingerprints", "suffix_dedup", "token_counts", "html_text", "spelling", "alignment", "warc")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> None:
    """Import every operator module, which fills the registry."""
    for name in MODULES:
        import_module(f"voxtable.llm.{name}")
