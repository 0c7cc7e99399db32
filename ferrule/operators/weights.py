"""Importance of call edges by flow: what a larger graph's edges contribute to what a smaller one misses.

Flow starts at one on each function that the smaller graph doesn't reach, runs from callees to
callers and from entries to a root, and is relaxed edge by edge, largest first. The procedure is
sequential by nature: each step depends on the one before. The work on rows (which nodes start,
which edges matter) is Spark's; the relaxation runs over the remaining edges, whose number is
checked, as one group.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import stored
from .graphs import reachable

# The share of a difference that one step moves, when to stop, the reset level.
SHARE, STOP, RESET = 1 / 8, 1e-3, 1e-12
#: Edges that one group may hold.
MOST_EDGES = 5_000_000


def relaxed(edges: pd.DataFrame, lost: set[int]) -> pd.DataFrame:
    """src, dst, weight of each edge; flow runs from dst to src, node -1 is the root.

    Ends when no edge has a difference of STOP: each step lowers the sum of squared levels, so there is an end.
    """
    src, dst = edges.src.tolist(), edges.dst.tolist()
    nodes = sorted(set(src) | set(dst))
    level = {n: 1.0 if n in lost else 0.0 for n in nodes}
    at: dict[int, list[int]] = {n: [] for n in nodes}
    for e, (a, b) in enumerate(zip(src, dst)):
        if a != -1:  # the root's level never changes
            at[a].append(e)
        if b != a:
            at[b].append(e)
    flow = [0.0] * len(edges)
    force = lambda e: level[dst[e]] - level[src[e]]
    queued = [force(e) for e in range(len(edges))]  # what each edge stands for in the heap, never less than its force
    heap = [(-f, e) for e, f in enumerate(queued) if f >= STOP]
    heapq.heapify(heap)
    steps = 0
    while heap:
        f, e = heapq.heappop(heap)
        if -f != queued[e]:
            continue
        now = force(e)
        if now < -f:  # it has sunk since
            queued[e] = now
            if now >= STOP:
                heapq.heappush(heap, (-now, e))
            continue
        a, b = src[e], dst[e]
        moved = now * SHARE
        flow[e] += moved
        level[a], level[b] = level[a] + moved, level[b] - moved
        steps += 1
        for n in (a, b):
            if n not in lost:
                level[n] = steps * RESET
        if -1 in level:
            level[-1] = 0.0
        queued[e] = 0.0  # it is in the heap no more
        for n in (a, b):
            for x in at[n]:
                now = force(x)
                if now > queued[x]:
                    queued[x] = now
                    if now >= STOP:
                        heapq.heappush(heap, (-now, x))
    return pd.DataFrame({"src": src, "dst": dst, "weight": flow})


def edge_weights(super_entry, super_edge, sub_entry, sub_edge) -> DataFrame:
    """src, dst, weight: how much each edge or entry (src -1) of the larger graph explains of what it adds."""
    edge = super_edge.select("src", "dst").distinct().unionByName(super_entry.select(F.lit(-1).cast("long").alias("src"), F.col("f").alias("dst")).distinct())
    extra = stored(reachable(super_entry, super_edge).subtract(reachable(sub_entry, sub_edge)))
    # only edges that can carry flow from lost nodes: those on the way from the root to one
    back = super_edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    carry = stored(reachable(extra, back))
    edge = stored(edge.join(carry.select(F.col("f").alias("dst")), "dst", "left_semi"))
    n = edge.count()
    if n > MOST_EDGES:
        raise ValueError(f"{n} edges in one relaxation; compare smaller graphs")
    rows = edge.join(extra.select(F.col("f").alias("dst"), F.lit(True).alias("lost")), "dst", "left").withColumn("g", F.lit(0))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["src", "dst"])
        return relaxed(group, set(group.dst[group.lost.notna()].tolist()))

    return rows.groupBy("g").applyInPandas(run, "src long, dst long, weight double")


def node_weights(super_entry, super_edge, sub_entry, sub_edge) -> DataFrame:
    """f, weight: the flow that leaves each function towards its callers."""
    return edge_weights(super_entry, super_edge, sub_entry, sub_edge).groupBy(F.col("dst").alias("f")).agg(F.sum("weight").alias("weight"))
