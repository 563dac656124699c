"""Connected components of a link table: alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise, salted_join


def _towards(edges: DataFrame, least: DataFrame) -> DataFrame:
    return salted_join(edges, least, "u", "l_u", "inner", F.col("v"), 4)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of ``links`` (columns a, b; longs, not NULL).

    A large-star step hangs a node's larger neighbours under its smallest one, a small-star step its smaller
    neighbours and itself. The smallest neighbour is a minimum (pre-aggregated), neighbours are never collected, and the join on a
    node with very many neighbours is salted. The number of rounds grows with the logarithm of the links."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = materialise(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("l_u")).agg(F.least(F.min("v"), F.col("l_u")).alias("m"))
        large = _towards(both, least).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large)
        low = large.groupBy(F.col("u").alias("l_u")).agg(F.min("v").alias("m"))          # all v < u here
        small = _towards(large, low).select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialise(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = edges.select(F.col("u").alias("e_u"), F.col("v").alias("e_v"))
    return nodes.join(top, F.col("node") == F.col("e_u"), "left").select("node", F.coalesce("e_v", "node").alias("root"))
