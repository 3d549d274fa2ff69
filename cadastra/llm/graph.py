"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a long, b long): nodes have the same root if edges connect them.

    Each round every node joins the neighbour (or itself) that is first in a random
    order of that round, and the edges between the joined nodes go on; expected rounds
    grow with the logarithm of the nodes. Roots are arbitrary nodes of their component.
    Tables written after each round cut the lineage. Self loops and repeated edges are allowed.
    """
    edges = written(edges.select("a", "b"))
    moves = []
    while True:
        salt = F.lit(len(moves))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("at"), F.col(c).alias("to"))
        move = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.first(order("a")))["to"].alias("to")))
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        joined = edges.join(left, "a").join(right, "b").filter("ta != tb")
        edges = written(joined.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if edges.isEmpty():
            break
    roots = moves.pop().withColumnRenamed("to", "root")
    while moves:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return written(roots)
