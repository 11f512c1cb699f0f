"""Connected components of a link table by hooking and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import spread_join, written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, root): the smallest node of each linked node's component.

    Each round points every node at its smallest neighbour, follows two pointers at once, and contracts the links;
    nodes per component shrink by a constant factor at least, in practice much faster. Nodes with many links are dealt over
    several tasks.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left = written(ordered(links), "links")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        ahead = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = spread_join(near, ahead, "root", "node").select("node", F.col("next").alias("root"))
        jumped = written(jumped, "roots")
        if found is None:
            found = jumped
        else:
            step = jumped.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = written(spread_join(found, step, "root", "node", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = (jumped.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        once = written(spread_join(left, a, "a", "b").select("ra", "b"), "links")
        left = written(ordered(spread_join(once, b, "b", "ra").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
