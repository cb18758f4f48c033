"""Connected components of a link table, without bringing links together in one task or the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.settle import settle

HUBS = 4096  # at most so many minima are broadcast in a step


def _contract(batches):
    """Union-find over one partition's links: a star for each component that they form."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    for start in range(0, len(nodes), 10_000):
        part = nodes[start : start + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def _with_least(links: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """links (u, v), and m, the least v of their u. A hub, whose links are a share of 1 / HUBS of ``most`` or
    more, has its minimum broadcast, and its links stay where they are. As links has ``most`` rows at most,
    there are HUBS hubs at most. least: (u, m, c), c being how many links u has."""
    hub = F.col("c") * HUBS >= most
    hubs = least.where(hub).select("u", "m")
    others = links.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return links.join(F.broadcast(hubs), "u").unionByName(others)


def components(links: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link to another: root is the smallest node reachable.

    Each partition first contracts its own links to stars; the stars are then joined by alternating
    large-star and small-star steps until none changes, each step written to the shared folder. A
    hub's links are never brought together.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).distinct()
    edges = settle(edges.mapInArrow(_contract, "u long, v long").where("u > v").distinct())
    state = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    before = state(edges)
    if not before["n"]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    least_of = lambda d: d.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, least_of(both), 2 * before["n"]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = settle(large.where("u > v").distinct())
        least = least_of(large)
        small = _with_least(large, least, before["n"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
