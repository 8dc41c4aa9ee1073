"""All queries of the network-fault operators, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("topology_queries", "series_queries", "evaluation_queries", "text_queries", "answer_queries", "flow_queries", "measure_queries", "network_queries", "study_queries", "chain_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"lumentrace.plans.{m}"), name)
    return out


def queries() -> dict:
    return _all("Q")


def oracle_sql() -> dict:
    return _all("O")


def entry(spark, sf_dir: str):
    return queries()["flow_summary"](spark, sf_dir)
