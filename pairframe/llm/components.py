"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp) for every node that has a link to another one.

    Each round hooks every node to its least neighbour, follows the hooks to
    their ends and contracts the links; rounds and hops both halve what is left,
    and every table is written to the shared folder. comp is some node of the
    component, the same for all its nodes.
    """
    both = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("near")).union(e.select("b", "a"))
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        hook = both(edges).groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        hook = stored(hook, "hooks")
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hop = stored(hook.join(above, "up", "left").select("node", "up", F.coalesce("top", "up").alias("top")), "hooks")
            moved = not hop.filter("top <> up").isEmpty()
            hook = hop.select("node", F.col("top").alias("up"))
            if not moved:
                break
        if labels is None:
            labels = hook.select("node", F.col("up").alias("comp"))
        else:
            up = hook.select(F.col("node").alias("comp"), "up")
            labels = stored(labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("x")), hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = stored(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
