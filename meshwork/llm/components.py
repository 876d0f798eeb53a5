"""Connected components of an edge table, its rounds written as this subpackage writes tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from .runtime import compacted


def connected_components(edges: DataFrame, files: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge touches; component: the smallest node.

    Self-loops and nulls are no edges; repeated and reversed edges are one.
    ``files``: in how many files a round is stored at most.
    """
    found = stars(edges, a, b, partial(compacted, files=files))
    centres = found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
