"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised once. What fills a whole window of the longest tier is cut off as such;
the rest of a document is routed to the smallest context tier that holds it. The plan is made
from the number of pieces of each length, at most LONGEST numbers whatever the input, tier by
tier, longest first. A piece of the longest tier opens a window of that size, and its gap is
filled with the longest pieces of shorter tiers that fit. A piece of a shorter tier opens a
window of its own tier's size, and its gap is filled from its tier and shorter ones if that can
be done exactly, as such a window is not padded. Pieces that no exact window takes are packed
into windows of the longest tier in the end, longest first, best fit. A pattern of lengths found
this way is used as often as its pieces last.

Pieces take their places by their rank among the pieces of their length, which is counted over
ranges of a hash, so neither a length that a third of all pieces share nor a repeated row is a
hot group. Step groups of STEP windows get every pattern, so every tier, in equal parts.

Defined results: null text is empty and has the end token only; repeated rows are packed one
by one; null doc_id is kept as null; an empty table gives an empty result; further columns are
ignored. The vocabulary's special token, if a text holds its string, becomes its id.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

LONGEST = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
STEP = 64
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_encoders: dict[str, object] = {}


def vocabulary() -> str:
    """The default vocabulary: the ranks of byte_bpe_50k.json, which give the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
        )
    return _encoders[path]


def token_ids(path: str, text: str) -> list[int]:
    enc = encoder(path)
    return enc.encode(text, allowed_special="all") if SPECIAL in text else enc.encode_ordinary(text)


def pieces(docs: DataFrame, path: str, longest: int = LONGEST) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*token_ids(path, text.as_py() or ""), END], "<u4")
                for start in range(0, len(ids), longest):
                    part = ids[start : start + longest]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def exact_fill(gap: int, free: np.ndarray, pieces: int = 3) -> list[tuple[int, int]] | None:
    """Lengths, each with a number of pieces, that fill a gap to the last token; None if no few do."""
    if gap == 0:
        return []
    if free[gap]:
        return [(gap, 1)]
    if pieces < 2:
        return None
    two = (free[1:gap] > 0) & (free[gap - 1 : 0 : -1] > 0)  # of lengths m and gap - m
    if gap % 2 == 0:
        two[gap // 2 - 1] = free[gap // 2] > 1
    if two.any():
        m = int(np.flatnonzero(two)[-1]) + 1
        return [(m, 1), (gap - m, 1)] if 2 * m != gap else [(m, 2)]
    fitting = np.flatnonzero(free[1:gap])
    if pieces < 3 or not len(fitting):
        return None
    m = int(fitting[-1]) + 1
    c = min(int(free[m]), gap // m)
    free = free.copy()
    free[m] -= c
    rest = exact_fill(gap - c * m, free, pieces - 1)
    return None if rest is None else [(m, c), *rest]


def plan(count: np.ndarray, longest: int = LONGEST, tiers=TIERS) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go, and the number of windows.

    count[n] is the number of pieces of length n. A row of the plan is (length, first rank,
    end rank, pieces a window, first window, offset, tier): rank r of that length goes to window
    first + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length.
    """
    left = count.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows, windows = [], 0

    def use(slots, tier):
        nonlocal windows
        need: dict[int, int] = {}
        for m, c in slots:
            need[m] = need.get(m, 0) + c
        times = min(int(left[m]) // c for m, c in need.items())
        offset = 0
        for m, c in need.items():
            rows.append((m, used[m], used[m] + c * times, c, windows, offset, tier))
            used[m] += c * times
            left[m] -= c * times
            offset += c * m
        windows += times

    def opened(n):
        free = left.copy()
        free[n] -= 1
        return free

    def best_fit(n):
        slots, gap, free = [(n, 1)], longest - n, opened(n)
        while gap:
            fitting = np.flatnonzero(free[: gap + 1])
            if not len(fitting):
                break
            m = int(fitting[-1])
            c = min(int(free[m]), gap // m)
            slots.append((m, c))
            free[m] -= c
            gap -= c * m
        return slots

    bounds = [0, *tiers]
    for lo, tier in reversed(list(zip(bounds, bounds[1:]))):
        for n in range(tier, lo, -1):
            while left[n]:
                if tier == longest:
                    use(best_fit(n), tier)
                    continue
                fill = exact_fill(tier - n, opened(n))
                if fill is None:
                    break
                use([(n, 1), *fill], tier)
    for n in range(longest, 0, -1):  # what no exact window took
        while left[n]:
            use(best_fit(n), longest)
    return np.array(rows or np.zeros((0, 7)), np.int64), windows


def pack(docs: DataFrame, path: str | None = None, tiers=TIERS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step of every piece.

    tier is the context size of the piece's window.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pieces(docs, path or vocabulary(), max(tiers)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "pieces")
    longest = max(tiers)
    count = np.zeros(longest + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most as many lengths as the longest tier has tokens
        count[r.length] = r["count"]
    where, windows = plan(count, longest, tiers)
    ranges = 4 * partitions(spark)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int"))
    sums = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "row")
    ranked = (
        rows.withColumn("i", F.row_number().over(inside))
        .join(sums.select("length", "part", "base"), ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("i") - 1)
    )
    # all ranks on one line: the pieces of length n begin at first[n]
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    begins = first[where[:, 0]] + where[:, 1]
    order = np.argsort(begins)
    shared = spark.sparkContext.broadcast((first, begins[order], where[order]))
    groups = max(1, -(-windows // STEP))
    even, more = divmod(windows, groups)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        first, begins, where = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            w = where[np.searchsorted(begins, first[length] + rank, "right") - 1]
            turn = rank - w[:, 1]
            window, offset = w[:, 4] + turn // w[:, 3], w[:, 5] + turn % w[:, 3] * length
            step = window % groups
            sequence = step * even + np.minimum(step, more) + window // groups
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in (sequence, offset, w[:, 6], step))],
                [*names, "sequence_id", "offset", "tier", "step"],
            )

    return ranked.select(*names, "rank").mapInArrow(
        place, ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset", "tier", "step"])
    )
