"""Collects the registered queries of every family."""

from __future__ import annotations

import importlib

FAMILIES = ("url_queries", "page_queries", "rank_queries", "manifest_queries", "freshness_queries", "queue_queries", "signal_queries", "analysis_queries", "transition_queries", "source_queries")


def _modules():
    return [importlib.import_module(f"segue.plans.{name}") for name in FAMILIES]


def queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}


def flagship(spark, sf_dir: str):
    return queries()["adjacent_transitions"](spark, sf_dir)
