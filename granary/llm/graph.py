"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from granary.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b`` long); root is the component's smallest node.

    Large-star links a node's larger neighbours to its smallest one, small-star
    its smaller ones; alternated, the edges become one star per component in a
    number of rounds that grows with the logarithm of the size.  Each round
    shuffles the edges, which never grow in number, and is checkpointed.  Edges
    lead from the larger node to the smaller, so a node's smallest neighbour is found
    among the ends of its own edges, and whether a round changed any is seen from
    figures that its checkpoint takes along.
    """

    def written(found: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        name = F.xxhash64("a", "b")
        figures = F.count(F.lit(1)).alias("n"), F.bit_xor(name).alias("bits"), F.sum(name.cast("decimal(38,0)")).alias("total")
        return checkpoint(found.observe(seen, *figures)), seen.get

    stars, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        low = stars.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
        large = stars.join(low, F.col("b") == F.col("x"), "left").select("a", F.coalesce("m", "b").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        stars, after = written(small)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
