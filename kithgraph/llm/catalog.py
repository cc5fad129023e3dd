"""The queries of the text operators and their SQL, for the driver's entry module."""

from __future__ import annotations

import importlib

MODULES = ("suffix_dedup", "pii", "exact_dedup", "packing", "near_dedup", "token_files", "html_text", "secrets", "quality", "decontaminate")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").SQL.items()}
