"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations with map-side minima and joins of two written tables, so that the neighbours of a node that has very many are split; edges are written to
the shared folder after each half round, so no lineage grows and nothing of them comes to the driver but a count and a checksum. Rounds needed grow
with the logarithm of the longest path.

Defined results: loops and repeated edges change nothing; no edges, no rows; nodes are longs, never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), b < a, written, to written ones. Large: neighbours above a node go to the least of its neighbourhood. Small: it and those below go there."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    new = written(out.where("a <> b").distinct(), "edges")
    drop_written(least)
    return new


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the least node of the component; nodes that are their own root are left out."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    told = None
    while True:
        half = _star(now, True)
        new = _star(half, False)
        sums = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        drop_written(now)
        drop_written(half)
        now = new
        if sums == told or not sums[0]:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._readloom_path = now._readloom_path  # noqa: SLF001
            return out
        told = sums
