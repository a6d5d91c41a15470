"""All registered queries."""

from tidemark.catalog import (  # noqa: F401
    encounter_queries,
    learner_queries,
    metric_queries,
    sweep_queries,
    text_queries,
    topic_queries,
)
from tidemark.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
