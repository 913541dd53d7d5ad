"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import HUB, dropped, hub_join, written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_min(pairs: DataFrame, hubs: bool) -> DataFrame:
    """Each pair (a, b) with m, the least of a and all its b. Without ``hubs`` no node
    has many links."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    if not hubs:
        return pairs.join(least.drop("n"), "a")
    return hub_join(pairs, written(least, "least"), "a")


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of the component of each node with a link.

    ``links`` has columns ``a`` and ``b``; their order, repeats and links from a
    node to itself make no difference, rows with a null are ignored. Nodes
    without a link to another are not returned; no links give no rows.

    Large-star and small-star steps alternate until nothing changes, a number
    of rounds that grows as the logarithm of the components' size. All work is
    joins and aggregates of links; a hub's links are joined where they are, never
    in one task. Each round is written to the shared folder, the one before goes.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    state = links.agg(F.count("*"), F.sum(mark)).first()
    while state[0]:
        hubs = 2 * state[0] > HUB
        large = _towards_min(_both_ways(links), hubs).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large") if hubs else large
        # After the large step every link points down, so a small step's neighbours are the b of a.
        small = _towards_min(large, hubs)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        old, links = links, written(small.filter("a <> b").distinct(), "links")
        dropped(old)
        before, state = state, links.agg(F.count("*"), F.sum(mark)).first()
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
