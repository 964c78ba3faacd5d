"""Compositions of operators, and the catalogue of named queries."""

from importlib import import_module

SECTIONS = ("search_queries", "page_queries", "ingest_queries", "conversation_queries", "commerce_queries", "telemetry_queries", "stream_queries")


def all_queries():
    """The catalogue with every section registered."""
    for section in SECTIONS:
        import_module(f"lorekeep.plans.{section}")
    return import_module("lorekeep.plans.catalog")
