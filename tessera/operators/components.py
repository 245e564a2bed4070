"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, remove


def _toward_least(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is re-hung on the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _among_smaller(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are all re-hung on the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns (id, component): each node that has an edge, with the least id it can reach.

    Edges with a null end or equal ends are left out; repeated edges count once; no edges give no
    rows. The two contractions alternate until the edge set stays the same, a number of rounds that
    is logarithmic in the longest chain. Each round is one table in the shared folder, and a hub's
    edges are pre-aggregated and joined, never gathered.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now, path = materialize(start.distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = mark
        following, to = materialize(_among_smaller(_toward_least(now)), "edges")
        remove(spark, path)
        now, path = following, to


def minimum_spanning_forest(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "distance") -> DataFrame:
    """(src, dst, weight) of a forest of least total weight; of equal weights the edge of smaller ends comes first.

    Borůvka's rounds: every component takes its first edge to another, the components that these link become one, and of parallel
    edges between two components the first stays. A round at least halves the components; its first edges and
    contraction are aggregations and joins. Below any weight the forest links what all edges up to it link.
    """
    spark = edges.sparkSession
    order = F.struct(F.col(weight).alias("w"), F.least(src, dst).alias("s"), F.greatest(src, dst).alias("t"))
    start = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"), order.alias("e"))
    now, path = materialize(start.groupBy("u", "v").agg(F.min("e").alias("e")), "forest-edges")
    taken = []
    while not now.isEmpty():
        both = now.select("u", F.struct("e", "v").alias("first")).union(now.select(F.col("v").alias("u"), F.struct("e", F.col("u").alias("v")).alias("first")))
        first, first_path = materialize(both.groupBy("u").agg(F.min("first").alias("first")).select("u", "first.v", "first.e"), "forest-first")
        chosen, _ = materialize(first.select("e").distinct(), "forest")
        taken.append(chosen)
        named, name_path = materialize(connected_components(first, "u", "v"), "forest-names")
        at = lambda end, out: named.select(F.col("id").alias(end), F.col("component").alias(out))  # noqa: B023, E731
        moved = now.join(at("u", "a"), "u").join(at("v", "b"), "v").where("a <> b")
        following, to = materialize(moved.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("e").alias("e")), "forest-edges")
        for old in (path, first_path, name_path):
            remove(spark, old)
        now, path = following, to
    whole = reduce(DataFrame.union, taken) if taken else now.select("e")
    return whole.select(F.col("e.s").alias(src), F.col("e.t").alias(dst), F.col("e.w").alias(weight))
