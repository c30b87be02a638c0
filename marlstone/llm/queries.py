"""The queries of this subpackage and of the pipeline, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("token_ids", "bpe", "quality", "decontam", "langid", "suffix_dedup", "minhash", "line_dedup", "licenses", "winnowing", "whitening", "media", "collocations")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


MODULES_NOW = _modules()  # imported with this module: one that can't be is told at once


def queries() -> dict:
    out: dict = {}
    for m in MODULES_NOW:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES_NOW:
        out |= m.SQL
    return out
