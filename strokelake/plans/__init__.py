"""Queries over the given tables, and their SQL twins."""

from strokelake.plans import evaluation, files, geometry, large, more, quality, sampling, scoring, tokens, vectors
from strokelake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "files", "geometry", "large", "more", "quality", "sampling", "scoring", "tokens", "vectors"]
