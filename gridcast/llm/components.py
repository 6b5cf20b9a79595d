"""Connected components of a link table by alternating star contraction.

Each round is two grouped minima and two joins, written to the shared scratch
folder; AQE splits the join of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.session import forget, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, the root being the smallest node of
    its component. ``links`` has columns a and b; nulls and self-links go."""
    spark = links.sparkSession
    edges, path = written(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "links")
    while True:  # each round takes nodes from every component that is no star yet
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        low = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = (both.join(low, "hi").where("lo > hi and lo <> m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        last = path
        edges, path = written(small, "links")
        forget(spark, last)
        # stars: every node points to one root, and no root points on
        ends = F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("out")),
                       F.struct(F.col("lo").alias("node"), F.lit(0).alias("out")))
        odd = (edges.select(F.explode(ends).alias("e")).groupBy("e.node")
               .agg(F.sum("e.out").alias("out"), F.min("e.out").alias("low"))
               .agg(F.count_if((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("low") == 0))).alias("n")))
        if not odd.first()["n"]:
            break
    return (edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
