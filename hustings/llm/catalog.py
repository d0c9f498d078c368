"""Queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import importlib

from .shared import QUERIES, Query

MODULES = ("bpe", "quality_rules", "near_dedup", "chat", "warc", "html_content", "substring", "decontaminate", "quality_classifier", "lm_scoring", "sharding", "centroid_clusters", "prefix_trie")


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
    return dict(QUERIES)
