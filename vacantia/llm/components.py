"""Connected components by alternating large and small stars, on edges that stay in Spark.

Each round connects every node's larger neighbours, then its smaller ones, to the least node it sees; after about
log^2 rounds every node points at the least node of its component. Minima are pre-aggregated before the shuffle and
joined back by sort-merge joins, whose hot keys AQE splits. Each round is checkpointed.

Edges that are counted and found to be LOCAL_EDGES at most, a few megabytes, are merged by one task instead: a round of
shuffles costs more than that. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LOCAL_EDGES = 250_000


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all edges; a set's root is its least node."""
    parent: dict = {}

    def find(x):
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].to_numpy(object), batch["v"].to_numpy(object), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pd.DataFrame({"node": pd.Series(part, dtype=object), "root": pd.Series([find(x) for x in part], dtype=object)})


def _print_of(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes: equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of some link, root being the least node reachable.

    Nodes are of any type with an order. Links may repeat and may run from a node to itself; links with a null end are
    left out; without links the result is empty.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    edges = checkpointed(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _print_of(edges)
    if seen[0] <= local_edges:
        kind = dict(edges.dtypes)["u"]
        return checkpointed(edges.coalesce(1).mapInPandas(_merged, f"node {kind}, root {kind}"))
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", "m")).distinct())
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v").toDF("node", "root"))
