"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link; root is the least node of its component.

    Each round joins links with the least neighbour of a node and sends the larger ends to it, so hot
    nodes are joins that adaptive execution can split, never lists. Rounds grow with the logarithm
    of a component's diameter. Rows with a null end are left out. Needs no list of links on the driver, which
    sees two numbers a round. Rounds are written to the shared folder, so a lost executor costs a round.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, seen = store(edges, "links"), None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its component's least so far keeps its neighbours; each neighbour points to the least
        large = large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = store(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
