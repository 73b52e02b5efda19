"""Registered queries: each is a job over the given tables, most with an equal SQL text."""

from caseloom.catalog import (  # noqa: F401
    data_queries,
    error_queries,
    feature_queries,
    log_queries,
    model_queries,
    text_queries,
)
from caseloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
