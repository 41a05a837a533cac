"""Queries ready to run over the star-schema tables."""

from importlib import import_module

MODULES = ["metric_queries", "domain_queries", "series_queries", "ingest_queries", "recommendation_queries", "table_queries", "state_queries"]


def load_catalog():
    """Import every query module and return the filled catalog."""
    for name in MODULES:
        import_module(f"metricmill.plans.{name}")
    return import_module("metricmill.plans.catalog")
