"""The queries of this folder and their SQL, gathered for the driver's entry module."""

from __future__ import annotations

import importlib

_MODULES = (
    "suffix_dedup",
    "topk_search",
    "simhash_dedup",
    "html_extract",
    "quality_rules",
    "mixing",
    "packing",
    "language_id",
    "warc",
    "secret_scan",
    "drake_kmeans",
    "line_dedup",
)


def _loaded():
    return [importlib.import_module(f"{__package__}.{name}") for name in _MODULES]


def queries():
    return {module.QUERY[0]: module.QUERY[1] for module in _loaded()}


def oracle_sql():
    return {module.QUERY[0]: module.SQL for module in _loaded() if module.SQL}
