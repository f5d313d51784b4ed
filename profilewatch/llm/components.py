"""Connected components of a table of links, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from .tables import Stored


def smallest_reachable(links: DataFrame, stored: Stored | None = None) -> DataFrame:
    """``id, component`` of every end of ``a, b`` links: the smallest id it is connected with.

    Alternates two steps until nothing changes: every node's larger neighbours are linked
    to its smallest neighbour, then its smaller ones are. Both are aggregations and
    joins by node; a node with many links is one row per link in a join that Spark may split,
    and the number of rounds grows with the logarithm of the longest path. Self links are allowed
    and give their node a component of its own. The result reads ``links`` and one table of ``stored``.
    """
    stored = stored or Stored(links.sparkSession, "components")
    edges = stored.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _sum(edges.filter("u != v"))
    while True:
        # large star: neighbours above u get the smallest around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, least, ["u"]).filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored.keep(large.filter("u != v"))
        # small star: neighbours below u, and u itself, get the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, below, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(below.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = stored.keep(small)
        stored.drop(large, edges)
        before, mark = mark, _sum(small)
        if mark == before:
            break
        edges = small
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = small.groupBy("u").agg(F.min("v").alias("m"))
    joined = nodes.join(found, nodes["id"] == found["u"], "left")
    return joined.select("id", F.coalesce("m", "id").alias("component"))


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
