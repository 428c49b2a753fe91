"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import cut

#: Far more rounds than the logarithm of any graph's size; running out is an error, never a partial answer.
MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): links every neighbour v of u, and u, with the least of them.

    The least value is a combined aggregate; the neighbours meet it in a join whose
    hot keys Spark splits, so that no list of neighbours is ever gathered in one place.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type: returns (node, root), root being the least node reachable.

    Only nodes that have an edge appear. Null ends, loops and repeated edges are ignored.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _digest(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        edges = cut(
            small.select(F.explode(F.array(F.col("v"), F.col("u"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        after = _digest(edges)
        if after == before:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
