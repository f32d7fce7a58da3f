"""Registered queries."""

from . import borders, build, cube, graph, more, rag, search, semantic, stars, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
