"""Connected components of a link table, distributed, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.session import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; ``edges`` are (u, v) with u > v, and so are the results."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = edges.join(least, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of each vertex that has a link; the component is its smallest vertex.

    Every round leaves at most as many edges as it found and is written; rounds grow as the logarithm of the longest
    path. The driver sees a count and a checksum. ``discard`` of the result deletes the table it is read from.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = cut(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == now or not now[0]:
            break
        before = now
        large = cut(_star(edges, True).distinct(), "edges")
        discard(edges)
        edges = cut(_star(large, False).distinct(), "edges")
        discard(large)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out._ionweave_path = edges._ionweave_path
    return out
