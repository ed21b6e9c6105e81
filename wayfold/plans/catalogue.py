"""All registered queries."""

from wayfold.plans import (  # noqa: F401
    core_queries,
    evidence_queries,
    governance_queries,
    path_queries,
    text_queries,
    verify_queries,
)
from wayfold.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
