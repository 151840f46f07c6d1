"""Connected components, whose rounds remove their shuffle files once they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, component: each vertex of an edge with the smallest vertex it reaches."""
    return graph.components(edges, a, b, written)
