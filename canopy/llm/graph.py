"""Connected components of an edge list by rounds of random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a long, b long); equal roots mean one component.

    In each round a node moves to its neighbour with the smallest seeded hash, or stays if
    its own is smaller; edges and labels follow.  Neighbours stay neighbours or meet, so
    components are kept, and the nodes left shrink by a constant share a round.  Minima are
    combined before the shuffle; both tables are written each round, so no lineage grows.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select("b", "a")).toDF("a", "b")

    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "cc-edges")
    labels = None
    for turn in range(most_rounds):
        own, other = F.xxhash64(F.lit(turn), "a"), F.xxhash64(F.lit(turn), "b")
        moved = both(left).groupBy("a").agg(F.min(F.struct(other.alias("h"), F.col("b").alias("to"))).alias("m")) \
            .select(F.col("a").alias("node"), F.when(F.col("m.h") < own, F.col("m.to")).otherwise(F.col("a")).alias("to"))
        moved = materialise(moved, "cc-moves")
        if labels is None:
            labels = moved.withColumnRenamed("to", "root")
        else:
            step = moved.withColumnRenamed("node", "root")
            labels = labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = materialise(labels, "cc-labels")
        a, b = moved.toDF("a", "a_to"), moved.toDF("b", "b_to")
        left = left.join(a, "a").join(b, "b").filter("a_to <> b_to") \
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        left = materialise(left, "cc-edges")
        if left.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
