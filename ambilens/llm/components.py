"""Connected components of a link table, by joins and map-side minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambilens.session import scratch_root, stage


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, component`` (its smallest member) for every node in links ``a, b`` (longs).

    Each round hangs every node on the smallest root next to it and then halves the
    paths to the roots; a path of n nodes takes about log n rounds. Minima combine on
    the map side and joins may be split by adaptive execution, so a component or node
    that holds most links isn't one task's work. State is stored after each round.
    """
    scratch_root(links.sparkSession)
    links = links.where(F.col("a") != F.col("b"))
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    # parent: every node with a smaller neighbour points to the smallest one.
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionAll(
        edges.select(F.col("a").alias("node"), F.col("a").alias("to"))
    )
    parent = stage(nodes.groupBy("node").agg(F.min("to").alias("parent")), "parents")
    for _ in range(max_rounds):
        parent = _flatten(parent)
        roots = parent.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        joined = edges.join(roots, "a").join(roots.toDF("b", "rb"), "b")
        open_ = stage(
            joined.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
        if open_.isEmpty():
            return parent.select("node", F.col("parent").alias("component"))
        # Links between roots are all that the next round needs.
        edges = open_
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("__hook"))
        parent = stage(
            parent.join(hooks, "node", "left")
            .select("node", F.coalesce("__hook", "parent").alias("parent")), "parents",
        )
    raise RuntimeError(f"Components did not settle in {max_rounds} rounds")


def _flatten(parent: DataFrame) -> DataFrame:
    """Point every node to its root by doubling."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("__up"))
        next_ = stage(
            parent.join(up, "parent", "left").select("node", F.coalesce("__up", "parent").alias("parent"),
                                                     (F.col("__up") != F.col("parent")).alias("__moved")),
            "parents",
        )
        moved = not next_.where("__moved").limit(1).isEmpty()
        parent = next_.drop("__moved")
        if not moved:
            return parent
