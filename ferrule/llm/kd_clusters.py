"""Centroid clustering by kd-tree filtering, in exact integers.

Vectors become whole numbers. Every partition packs what it reads into blocks of BLOCK vectors
and builds a kd-tree over each: cut at the median of the widest side until LEAF vectors are
left. A tree is one written row with its vectors in the tree's order and, for each node, its
range, count, integer sums, sum of squares and box. A round sends the centroids (k times dim
numbers) to the trees. A node keeps the centroids that may be nearest to some point of its box:
one is pruned where it is strictly farther than another over the whole box. A node with one
centroid left is assigned as a whole, by its count and sums; a leaf with several is resolved
vector by vector. Blocks give counts and sums by centroid, which Spark adds; k rows reach the
driver. No vector moves between tasks after the trees are written.

All comparisons are exact: with components up to MOST, every product and distance is a whole
number below 2^53. In many dimensions without clusters boxes overlap all centroids and most
leaves are resolved one by one; then work is that of plain rounds.

Defined results: vectors that are null, of another length or hold null or non-finite components
take no part and have no row; repeated rows count each; of equal ids the smaller vector comes
first, null ids come last as first centroids; with fewer vectors than centroids there are as
many centroids as vectors; a component beyond MOST (after scaling) is an error, as distances
would not be exact; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 4096, 32
#: The largest component: 64 products of two such sum to 2^50.
MOST = 1 << 22
_FAR = np.float64(1 << 60)


def kept(vectors: DataFrame, dim: int, vec: str) -> DataFrame:
    """The rows whose vector takes part."""
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).where(~bad)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """The components as whole numbers."""
    out = np.floor(scale * x.astype(np.float64))
    if out.size and np.abs(out).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} after scaling: distances would not be exact")
    return out.astype(np.int32)


def tree(v: np.ndarray) -> dict[str, np.ndarray]:
    """order of the rows of v, and of each node start, stop, left (its left child, 0 for a leaf; the right one follows), count, sums, squares and box."""
    order = np.arange(len(v))
    start, stop, left, boxes = [0], [len(v)], [0], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        mine = v[order[a:b]]
        lo, hi = mine.min(0), mine.max(0)
        boxes.append((lo, hi))
        side = int((hi.astype(np.int64) - lo).argmax())
        if b - a > LEAF and hi[side] > lo[side]:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, side], middle)]
            left[at] = len(start)
            start += [a, a + middle]
            stop += [a + middle, b]
            left += [0, 0]
        at += 1
    v = v[order].astype(np.int64)
    sums = np.zeros((len(v) + 1, v.shape[1]), np.int64)
    np.cumsum(v, axis=0, out=sums[1:])
    squares = np.concatenate([[0], np.cumsum((v * v).sum(1))])
    start, stop = np.array(start), np.array(stop)
    return {
        "order": order, "start": start, "stop": stop, "left": np.array(left), "sums": sums[stop] - sums[start], "squares": squares[stop] - squares[start],
        "lo": np.array([x for x, _ in boxes]), "hi": np.array([x for _, x in boxes]),
    }


#: Columns of a written tree and the types of their numbers.
PARTS = {"start": np.int32, "stop": np.int32, "left": np.int32, "sums": np.int64, "squares": np.int64, "lo": np.int32, "hi": np.int32, "vectors": np.int32}


def trees(rows: DataFrame, dim: int, scale: int, vec: str) -> DataFrame:
    """A row for each block of rows(id, vec): ids in the tree's order, and the tree's parts as bytes."""
    kind = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal ids, vectors, n
            v, names = np.concatenate(vectors), pa.chunked_array(ids)
            head, t = names.slice(0, BLOCK), tree(v[:BLOCK])
            named = pa.concat_arrays(head.chunks).take(pa.array(t["order"]))
            t["vectors"] = v[:BLOCK][t["order"]]
            parts = [pa.array([np.ascontiguousarray(t[k], d).tobytes()], pa.binary()) for k, d in PARTS.items()]
            row = [pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named), *parts]
            ids, vectors, n = [x for x in names.slice(BLOCK).chunks if len(x)], [v[BLOCK:]], max(0, n - BLOCK)
            return pa.RecordBatch.from_arrays(row, ["ids", *PARTS])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0))
                vectors.append(whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale))
                n += batch.num_rows
            while n >= BLOCK:
                yield block()
        if n:
            yield block()

    small_batches(rows.sparkSession)
    return rows.select("id", F.col(vec).alias("vec")).mapInArrow(build, f"ids array<{kind}>, " + ", ".join(f"{k} binary" for k in PARTS))


def unpacked(batch: pa.RecordBatch, i: int, dim: int) -> dict[str, np.ndarray]:
    """The parts of row i."""
    t = {k: np.frombuffer(batch.column(j + 1)[i].as_buffer(), d) for j, (k, d) in enumerate(PARTS.items())}
    return {k: x.reshape(-1, dim) if k in ("sums", "lo", "hi", "vectors") else x for k, x in t.items()}


def possible(t: dict[str, np.ndarray], nodes: np.ndarray, may: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """may (nodes by centroids) without the centroids that another one beats strictly over a node's whole box."""
    lo, hi = t["lo"][nodes].astype(np.int64), t["hi"][nodes].astype(np.int64)
    off = (lo + hi)[:, None, :] - 2 * centres[None]
    near = np.where(may, (off.astype(np.float64) ** 2).sum(2), np.inf).argmin(1)
    out, size = may.copy(), (centres * centres).sum(1)
    for best in np.unique(near):
        here = near == best
        way = centres - centres[best]
        # twice the largest product of a point of the box with the way from best to each centroid
        reach = 2 * (hi[here] @ np.maximum(way, 0).T + lo[here] @ np.minimum(way, 0).T)
        out[here] &= (size - size[best])[None] - reach <= 0
    return out


def assigned(t: dict[str, np.ndarray], centres: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(node, centroid) of the nodes assigned as a whole; the other rows and the centroid of each."""
    k, nodes = len(centres), np.zeros(1, np.int64)
    may, wholes, rows, choices = np.ones((1, k), bool), [], [], []
    while len(nodes):
        may = possible(t, nodes, may, centres)
        one = may.sum(1) == 1
        wholes += zip(nodes[one].tolist(), may[one].argmax(1).tolist())
        nodes, may = nodes[~one], may[~one]
        leaf = t["left"][nodes] == 0
        for node, m in zip(nodes[leaf].tolist(), may[leaf]):
            rows.append(np.arange(t["start"][node], t["stop"][node]))
            choices.append(np.broadcast_to(m, (len(rows[-1]), k)))
        below = t["left"][nodes[~leaf]].astype(np.int64)
        nodes, may = np.concatenate([below, below + 1]), np.concatenate([may[~leaf], may[~leaf]])
    if not rows:
        return wholes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.concatenate(rows)
    v, c = t["vectors"][rows].astype(np.float64), centres.astype(np.float64)
    apart = np.where(np.concatenate(choices), (c * c).sum(1)[None] - 2 * (v @ c.T), _FAR)
    return wholes, rows, apart.argmin(1)  # the first of equals: the smaller number


def totals(forest: DataFrame, centres: np.ndarray) -> list[tuple[int, list[int], int]]:
    """count, sums and sum of squares of the vectors of each centroid."""
    k, dim = centres.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = unpacked(batch, i, dim)
                n, sums, squares = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
                wholes, rows, chosen = assigned(t, centres)
                for node, c in wholes:
                    n[c] += t["stop"][node] - t["start"][node]
                    sums[c] += t["sums"][node]
                    squares[c] += t["squares"][node]
                v = t["vectors"][rows].astype(np.int64)
                for c in np.unique(chosen):
                    mine = v[chosen == c]
                    n[c] += len(mine)
                    sums[c] += mine.sum(0)
                    squares[c] += (mine * mine).sum()
                offsets = pa.array(np.arange(0, k * dim + 1, dim), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(k), pa.int32()), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())), pa.array(squares)], ["c", "n", "sums", "squares"]
                )

    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = forest.mapInArrow(count, "c int, n long, sums array<long>, squares long").groupBy("c")
    rows = found.agg(F.sum("n").alias("n"), F.array(*[big(F.col("sums")[d]) for d in range(dim)]).alias("sums"), big(F.col("squares")).alias("squares")).collect()
    out = [(0, [0] * dim, 0)] * k
    for r in rows:  # one for each centroid
        out[r.c] = (r.n, [int(x) for x in r.sums], int(r.squares))
    return out


def first_centres(rows: DataFrame, k: int, scale: int, seed: int, vec: str) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(key.alias("key"), F.col(vec).alias("vec")).orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([whole(np.array(r.vec), scale) for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    rows = kept(vectors, dim, vec).select(F.col(id).alias("id"), F.col(vec).alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    centres = first_centres(rows, k, scale, seed, "vec")
    forest = written(trees(rows, dim, scale, "vec"), "trees")
    if not len(centres):
        centres = np.zeros((1, dim), np.int64)
        rounds = 0
    for _ in range(rounds):
        sums = totals(forest, centres)
        # floor of the exact mean; one without vectors stays
        centres = np.array([[s // n for s in total] if n else old.tolist() for old, (n, total, _) in zip(centres, sums)], np.int64)
    inertia = [
        squares - 2 * sum(a * b for a, b in zip(total, c)) + n * sum(a * a for a in c) for (n, total, squares), c in zip(totals(forest, centres), centres.tolist())
    ]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, ids = unpacked(batch, i, dim), batch.column(0)[i].values
                wholes, at, chosen = assigned(t, centres)
                c = np.empty(len(ids), np.int64)
                c[at] = chosen
                for node, one in wholes:
                    c[t["start"][node] : t["stop"][node]] = one
                off = t["vectors"] - centres[c]
                columns = [ids, pa.array(c, pa.int32()), pa.array((off * off).sum(1)), pa.array([inertia[x] for x in c], pa.int64())]
                columns += [pa.array([sum(inertia)] * len(c), pa.int64()), pa.array([names[x] for x in c], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = forest.mapInArrow(told, f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", id)
