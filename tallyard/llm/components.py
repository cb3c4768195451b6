"""Connected components of an edge table: forests of the tasks' own edges, then alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: A node with more than one in HOT of all edges is a hub; there are at most 2 HOT of them, so they are broadcast.
HOT = 2000
#: Edges that a task joins in its own memory.
HELD = 50_000


def with_least(edges: DataFrame, keyed: DataFrame, total: int) -> DataFrame:
    """keyed (u, v) with m, the least neighbour of u among edges (u, v).

    The minima of hubs are broadcast (2 HOT rows at most, by the sum of the degrees), so that a hub's edges stay where they
    are; the others meet theirs in a join in which no key has more than total / HOT rows.
    """
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), "m", (F.col("n") > total / HOT).alias("hub")), "least")
    hubs = F.broadcast(least.filter("hub").select(F.col("k").alias("hub"), F.col("m").alias("hub_m")))
    marked = keyed.join(hubs, F.col("u") == F.col("hub"), "left")
    light = marked.filter("hub is null").select("u", "v").join(least.filter("not hub").select("k", "m"), F.col("u") == F.col("k")).select("u", "v", "m")
    return marked.filter("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(light)


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, both.filter("v > u"), 2 * total).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them.  edges: u > v."""
    moved = with_least(edges, edges, total)
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def contracted(batches):
    """(u, v) of each node of a task's edges, v the smallest node that these edges reach from it (itself for that one).

    Holds at most some 2 HELD nodes: beyond that their trees are given out and a new forest begins.
    """
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    def trees() -> pa.RecordBatch:
        nodes = list(up)
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])
        up.clear()
        return out

    for batch in slices(batches, 8192):
        for x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 2 * HELD:
            yield trees()
    yield trees()


def census(edges: DataFrame):
    """n, the number of edges, and far, the nodes that are not yet leaves of one star or its centre.  edges: u > v."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).alias("far")).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the (u, v) edges; component is the smallest node reachable.

    Tasks of HELD edges first join what they hold; a table that fits one task is solved by that.  A larger one goes on with the
    alternating steps until only stars are left.  Each step is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = stored(edges.filter("u <> v").select("u", "v"), name)
    n, before = edges.count(), None
    while before is None or n <= before / 2:
        tasks = max(1, math.ceil(n / HELD))
        joined = stored(edges.coalesce(tasks).mapInArrow(contracted, "u long, v long"), name)
        if tasks == 1:
            return joined.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = joined.filter("u <> v")
        n, before = edges.count(), n
    while (now := census(edges))["far"]:
        edges = stored(large_star(edges, now["n"]).distinct(), name)
        edges = stored(small_star(edges, now["n"]).distinct(), name)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
