"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are one index. Its top is a net of at most CENTERS points; every vector belongs
to the cell of its nearest centre, and cells are cut into blocks of bounded size by a hash, so a
vector that a third of all rows repeat fills several blocks. A block is a cover tree of its own:
the children of a node are a net of its points, separated by half its covering radius (or, where
that takes more than FAN children, the FAN points farthest from each other), down to leaves of
LEAF points.

The queries of a block are a query group. Each group first meets its own block, which gives a
worst kth score. For groups and blocks, centre and covering radius are known by then, and only
pairs that can still matter are joined: with centres cq, cx and radii rq, rx no inner product is
above cq.cx + |cq| rx + |cx| rq + rq rx, and pairs whose bound is below the group's worst kth
score are pruned before any vector moves. Surviving blocks meet surviving groups in tasks of
bounded size, where the query tree is walked from its root down, each node handing on the data
nodes that its own worst kth score does not prune; at its leaves data leaves are scored exactly,
best bound first, as the worst kth score rises.

Components become floor(scale * x) first, so scores are whole numbers and exact.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; a row without id is no query, but a candidate, as which it comes last among equal scores
(so does the id 2**63 - 1, which reads as null); vectors meet only those of equal dimension; a
query's own row is no candidate, others of its id are; repeated queries are answered each; an
empty table gives an empty result; further columns are ignored. Of more than MOST_NETS
dimensions the rarer ones are one cell each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import erased, partitions, small_batches, written

#: Points of the top net; dimensions with such a net; rows of a block; blocks, and query groups, that meet in a task.
CENTERS, MOST_NETS, BLOCK, BLOCKS_A_TASK, GROUPS_A_TASK = 64, 64, 4096, 16, 128
#: Children of a node, and points of a leaf.
FAN, LEAF = 16, 64
#: Rows scored at once.
ROWS = 1024
NO_ID = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """row, vec_id, dim and vec (doubles holding whole numbers) of the vectors that take part."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    return (
        rows.where(good & ~odd)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), vec.alias("vec"))
        .withColumn("row", F.monotonically_increasing_id())
    )


def net(points: np.ndarray, most: int, apart: float = 0.0, first: int = 0) -> np.ndarray:
    """Numbers of farthest-first centres: no point is farther than apart from one, or there are as many as allowed."""
    chosen = [first]
    far = ((points - points[first]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(points)) and far.max() > apart**2:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * points @ centers.T).argmin(axis=1)


class Tree:
    """A cover tree: points in the order of its leaves, and for each node its centre, covering radius, points and children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        centers, radius, start, end, self.children = [], [], [], [], []

        def node(a: int, b: int, center: np.ndarray) -> int:
            own = points[self.order[a:b]]
            centers.append(center)
            # rounded up, as bounds must hold
            radius.append(float(np.sqrt(((own - center) ** 2).sum(axis=1).max())) * (1 + 1e-12) + 1e-9)
            start.append(a)
            end.append(b)
            self.children.append(np.zeros(0, np.int64))
            return len(centers) - 1

        todo = [node(0, len(points), points[0])]
        while todo:
            at = todo.pop()
            a, b = start[at], end[at]
            own = points[self.order[a:b]]
            if b - a <= leaf or (own == own[0]).all():
                continue
            seeds = net(own, FAN, radius[at] / 2, int(((own - centers[at]) ** 2).sum(axis=1).argmin()))
            child = nearest(own, own[seeds])
            order = np.argsort(child, kind="stable")
            self.order[a:b] = self.order[a:b][order]
            names, cut = np.unique(child[order], return_index=True)
            if len(names) < 2:
                continue
            ends = [*cut[1:].tolist(), b - a]
            self.children[at] = np.array([node(a + x, a + y, own[seeds[n]]) for n, x, y in zip(names, cut.tolist(), ends)])
            todo += self.children[at].tolist()
        self.points = points[self.order]
        self.centers, self.radius = np.array(centers), np.array(radius)
        self.norm = np.sqrt((self.centers**2).sum(axis=1))
        self.start, self.end = np.array(start), np.array(end)
        self.leaf = np.array([not len(c) for c in self.children])


def forest(points: list[np.ndarray]) -> Tree:
    """The trees of several sets of points as children of one root."""
    trees = [Tree(p) for p in points]
    if len(trees) == 1:
        return trees[0]
    out = Tree(trees[0].points[:1])
    shift, at, base = [], 0, 1
    for t in trees:
        shift.append((at, base))
        at, base = at + len(t.points), base + len(t.radius)
    sizes = np.cumsum([0, *(len(t.points) for t in trees)])
    out.order = np.concatenate([t.order + n for t, n in zip(trees, sizes)])
    out.points = np.concatenate([t.points for t in trees])
    out.centers = np.concatenate([out.centers, *(t.centers for t in trees)])
    out.radius = np.concatenate([[np.inf], *(t.radius for t in trees)])
    out.norm = np.concatenate([out.norm, *(t.norm for t in trees)])
    out.start = np.concatenate([[0], *(t.start + a for t, (a, _) in zip(trees, shift))])
    out.end = np.concatenate([[at], *(t.end + a for t, (a, _) in zip(trees, shift))])
    out.children = [np.array([b for _, b in shift]), *(c + b for t, (_, b) in zip(trees, shift) for c in t.children)]
    out.leaf = np.concatenate([[False], *(t.leaf for t in trees)])
    return out


def bound(cq, rq, nq, centers, radius, norm):
    """No inner product of a node with the nodes given is higher."""
    return centers @ cq + nq * radius + norm * rq + rq * radius


def merged(best, scores, ids, rows, own, k: int):
    """The k best of each query, with ties to smaller ids, from the best so far and new scores."""
    scores = np.where(rows[None, :] == own[:, None], -np.inf, scores)
    worst = best[0][:, -1]
    if scores.shape[1] > 4 * k:  # what is below the kth score can't enter; equal scores can
        worst = np.maximum(-np.partition(-scores, k - 1, axis=1)[:, k - 1], worst)
    q, at = np.nonzero((scores >= worst[:, None]) & (scores > -np.inf))
    if not len(q):
        return best
    old = np.repeat(np.arange(len(own)), k)
    q = np.concatenate([old, q])
    s = np.concatenate([best[0].ravel(), scores[q[len(old) :], at]])
    i = np.concatenate([best[1].ravel(), ids[at]])
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    head = np.searchsorted(q, np.arange(len(own)))
    take = head[:, None] + np.arange(k)
    return s[take], i[take]


def search(asks: Tree, own: np.ndarray, floor: np.ndarray, data: Tree, ids: np.ndarray, rows: np.ndarray, k: int, seen: dict | None = None):
    """Scores and ids of the k best of each query of asks, in its order; floor: scores that each has anyway.

    own and floor are in the order of asks, ids and rows in that of data. seen counts node pairs.
    """
    n = len(asks.points)
    scores, found = np.full((n, k), -np.inf), np.full((n, k), NO_ID)
    # a NaN in a bound (a root without radius against a norm of 0) must not prune
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, frontier = todo.pop()
        a, b = asks.start[q], asks.end[q]
        worst = floor[a:b].min()
        inner = frontier[~data.leaf[frontier] & (~(data.radius[frontier] < asks.radius[q]) | asks.leaf[q])]
        ready = [frontier[data.leaf[frontier] | ~np.isin(frontier, inner)]]
        while len(inner):
            below = np.concatenate([data.children[x] for x in inner])
            high = bound(asks.centers[q], asks.radius[q], asks.norm[q], data.centers[below], data.radius[below], data.norm[below])
            stays = ~(high < worst)
            if seen is not None:
                seen["pairs"] += len(below)
                seen["pruned"] += int((~stays).sum())
            below = below[stays]
            more = ~data.leaf[below] & asks.leaf[q]
            ready.append(below[~more])
            inner = below[more]
        frontier = np.concatenate(ready)
        if not len(frontier):
            continue
        if not asks.leaf[q]:
            todo += [(int(c), frontier) for c in asks.children[q]]
            continue
        high = bound(asks.centers[q], asks.radius[q], asks.norm[q], data.centers[frontier], data.radius[frontier], data.norm[frontier])
        order = np.argsort(-high, kind="stable")
        frontier, high = frontier[order], high[order]
        mine, at = (scores[a:b], found[a:b]), 0
        size = data.end[frontier] - data.start[frontier]
        while at < len(frontier) and not high[at] < np.maximum(mine[0][:, -1], floor[a:b]).min():
            end = at + 1 + int(np.searchsorted(np.cumsum(size[at:]), ROWS))
            pick = np.concatenate([np.arange(data.start[x], data.end[x]) for x in frontier[at:end]])
            mine = merged(mine, asks.points[a:b] @ data.points[pick].T, ids[pick], rows[pick], own[a:b], k)
            at = end
        scores[a:b], found[a:b] = mine
    return scores, found


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


def _answers(asks: Tree, queries, scores: np.ndarray, ids: np.ndarray):
    import pandas as pd

    q, s = np.nonzero(scores > -np.inf)
    at = asks.order[q]
    return pd.DataFrame(
        {"row": queries.row.to_numpy()[at], "query_id": queries.vec_id.to_numpy()[at], "vec_id": ids[q, s], "score": scores[q, s].astype(np.int64)}
    )


def top_k(rows: DataFrame, every: int, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row whose id is divisible by every."""
    import pandas as pd

    spark = rows.sparkSession
    small_batches(spark)
    vectors = written(whole_vectors(rows, scale), "vectors")
    often = vectors.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(MOST_NETS).collect()
    nets = {}
    for dim in sorted(r.dim for r in often):  # the net's points: a hash sample of fixed size
        sample = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "row"), "row").limit(16 * CENTERS).select("vec").collect()
        points = np.array([r.vec for r in sample])
        nets[dim] = points[net(points, CENTERS)]
    shared = spark.sparkContext.broadcast(nets)

    def cells(batches):
        for batch in batches:
            dim, blobs, cell = batch.column("dim").to_numpy(), [], np.zeros(batch.num_rows, np.int64)
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(dim)])
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                points = np.stack([flat[at[i] : at[i + 1]] for i in own])
                cell[own] = nearest(points, shared.value[d]) if d in shared.value else 0
            blobs = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("dim"), pa.array(cell.astype(np.int32)), pa.array(blobs, pa.binary())],
                ["row", "vec_id", "dim", "cell", "vec"],
            )

    asks_for = F.coalesce(F.pmod("vec_id", F.lit(every)) == 0, F.lit(False))
    placed = vectors.select("row", "vec_id", "dim", "vec").mapInArrow(cells, "row long, vec_id long, dim int, cell int, vec binary")
    placed = written(placed.select("row", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "dim", "cell", "vec", asks_for.alias("asks")), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    salt = F.pmod(F.xxhash64("row", F.lit("block")), F.col("blocks")).cast("int")
    placed = written(placed.join(sizes, ["dim", "cell"]).withColumn("block", salt).drop("blocks"), "placed")

    def home(key, block):
        """A block against its own queries; its centre and radius, and those of its queries with their worst kth score."""
        dim, points = int(key[0]), _matrix(block.vec, int(key[0]))
        asked = block.asks.to_numpy()
        center = points.mean(axis=0)
        reach = lambda p: float(np.sqrt(((p - center) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        def told(kind, n, **columns):
            whole = {c: np.zeros(n, np.int64) for c in ("row", "query_id", "vec_id", "score")}
            rest = {"floor": np.zeros(n), "radius": np.zeros(n), "center": [b""] * n}
            return pd.DataFrame({"kind": kind, "dim": dim, "cell": int(key[1]), "block": int(key[2]), **whole, **rest, **columns})

        out = [told(1, 1, center=[center.tobytes()], radius=reach(points))]
        if asked.any():
            queries, tree = block[asked], Tree(points)
            asks = Tree(points[asked])
            ids, own, mine = block.vec_id.to_numpy()[tree.order], block.row.to_numpy()[tree.order], queries.row.to_numpy()[asks.order]
            scores, found = search(asks, mine, np.full(len(queries), -np.inf), tree, ids, own, k)
            answers = _answers(asks, queries, scores, found)
            out.append(told(0, len(answers), **{c: answers[c].to_numpy() for c in answers}))
            out.append(told(2, len(queries), row=mine, floor=scores[:, -1]))
            out.append(told(3, 1, center=[center.tobytes()], radius=reach(points[asked]), floor=scores[:, -1].min()))
        return pd.concat(out)

    shape = "kind int, dim int, cell int, block int, row long, query_id long, vec_id long, score long, floor double, radius double, center binary"
    first = written(placed.groupBy("dim", "cell", "block").applyInPandas(home, shape), "home")
    asked = written(placed.where("asks").join(first.where("kind = 2").select("row", "floor"), "row"), "queries")

    # pairs of blocks and query groups that may matter; every task gets a share of the blocks and all groups
    shares = 4 * partitions(spark)
    share = F.pmod(F.xxhash64("cell", "block"), F.lit(shares)).cast("int")
    blocks = first.where("kind = 1").select("dim", "cell", "block", "center", "radius", share.alias("share"))
    groups = first.where("kind = 3").select("dim", "cell", "block", "center", "radius", "floor", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def survive(key, blocks, groups):
        names = ["dim", "cell", "part", "group_cell", "group_block"]
        if not len(blocks) or not len(groups):
            return pd.DataFrame({n: [] for n in names})
        dim, out = int(key[0]), []
        centers, radius = _matrix(blocks.center, dim), blocks.radius.to_numpy()
        norm = np.sqrt((centers**2).sum(axis=1))
        cell, block = blocks.cell.to_numpy(), blocks.block.to_numpy()
        for g in groups.itertuples():
            cq = np.frombuffer(g.center, np.float64)
            high = bound(cq, g.radius, float(np.sqrt((cq**2).sum())), centers, radius, norm)
            slack = 1e-6 * (1 + np.abs(high))
            may = np.flatnonzero(~(high + slack < g.floor) & ~((cell == g.cell) & (block == g.block)))
            out.append(pd.DataFrame({"dim": dim, "cell": cell[may], "part": block[may] // BLOCKS_A_TASK, "group_cell": g.cell, "group_block": g.block}))
        return pd.concat(out).drop_duplicates()[names]

    blocks, groups = (df.toDF(*df.columns) for df in (blocks, groups))
    pairs = blocks.groupBy("dim", "share").cogroup(groups.groupBy("dim", "share")).applyInPandas(survive, "dim int, cell int, part int, group_cell int, group_block int")
    pairs = written(pairs.distinct(), "pairs")
    chunks = max(1, -(-first.where("kind = 3").count() // GROUPS_A_TASK))
    chunk = F.pmod(F.xxhash64("group_cell", "group_block"), F.lit(chunks)).cast("int")
    pairs = pairs.withColumn("chunk", chunk)
    data = placed.withColumn("part", F.floor(F.col("block") / BLOCKS_A_TASK).cast("int"))
    data = data.join(pairs.select("dim", "cell", "part", "chunk").distinct(), ["dim", "cell", "part"])
    to = pairs.select("dim", F.col("cell").alias("to_cell"), "part", "chunk", F.col("group_cell").alias("cell"), F.col("group_block").alias("block"))
    queries = asked.join(to, ["dim", "cell", "block"]).select("dim", F.col("to_cell").alias("cell"), "part", "chunk", "row", "vec_id", "vec", "floor", F.col("cell").alias("own_cell"), F.col("block").alias("own_block"))

    def meet(key, data, queries):
        none = pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        if not len(queries) or not len(data):
            return none
        dim, out = int(key[0]), []
        groups = list(data.groupby("block", sort=True))
        tree = forest([_matrix(g.vec, dim) for _, g in groups])
        ids, own = (np.concatenate([g[c].to_numpy() for _, g in groups])[tree.order] for c in ("vec_id", "row"))
        home = np.concatenate([g.block.to_numpy() for _, g in groups])[tree.order]
        for (cell, block), q in queries.groupby(["own_cell", "own_block"], sort=True):
            asks = Tree(_matrix(q.vec, dim))
            if cell == key[1] and (home == block).any():  # answered at home already
                at = np.flatnonzero(home != block)
                if not len(at):
                    continue
                part = [g for g in groups if g[0] != block]
                other = forest([_matrix(g.vec, dim) for _, g in part])
                names, rows = (np.concatenate([g[c].to_numpy() for _, g in part])[other.order] for c in ("vec_id", "row"))
            else:
                other, names, rows = tree, ids, own
            scores, found = search(asks, q.row.to_numpy()[asks.order], q.floor.to_numpy()[asks.order], other, names, rows, k)
            out.append(_answers(asks, q, scores, found))
        return pd.concat(out) if out else none

    grid = ["dim", "cell", "part", "chunk"]
    data, queries = (df.toDF(*df.columns) for df in (data, queries))
    met = data.groupBy(*grid).cogroup(queries.groupBy(*grid)).applyInPandas(meet, "row long, query_id long, vec_id long, score long")
    answers = written(first.where("kind = 0").select("row", "query_id", "vec_id", "score").unionByName(met), "answers")
    erased(vectors, placed, first, asked)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    best = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
