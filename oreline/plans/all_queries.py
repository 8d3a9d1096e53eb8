"""Importing this module fills the catalogue."""

from oreline.plans import (  # noqa: F401
    mining_queries, model_queries, operations_queries, quality_queries, relational_queries, table_queries,
)
from oreline.plans.catalog import QUERIES, TWINS  # noqa: F401
