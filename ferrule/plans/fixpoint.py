"""Least fixpoints by semi-naive evaluation.

A round joins only what the last round found. Its result is anti-joined with all that is known
and written, which also ends the lineage. Several relations that depend on each other are one
relation with a tag column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import LARGE, SMALL, counted, light, one_partition, stored

#: Written parts of the result after which they become one.
PARTS = 8


class NotConverged(RuntimeError):
    """The rounds allowed ended before a fixpoint was reached."""


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unknown(found: DataFrame, known: DataFrame, keys: list[str], total: int, last: int) -> tuple[DataFrame, int]:
    """The rows of found that are not among the total rows of known, written, and their number.

    Where the last round found few rows, known is scanned for those of this one and not shuffled.
    """
    if total > LARGE and last <= SMALL:
        found, n = counted(found)
        if n <= SMALL:
            known = F.broadcast(known.select(keys).join(F.broadcast(found.select(keys)), keys, "left_semi"))
    return counted(found.join(known, keys, "left_anti").select(found.columns), total <= SMALL)


def fixpoint(
    seed: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    keys: list[str] | None = None,
    max_rounds: int = 10_000,
) -> DataFrame:
    """The least relation that holds seed and step(new rows, all rows).

    step gets the rows of the last round, and all rows with them; a rule with two recursive
    atoms must join both ways (new with all, all with new). keys: the columns that identify a
    row, all by default; of rows with equal keys that one round finds, one stays.
    """
    columns = seed.columns
    keys = keys or columns
    delta, n = counted(seed.dropDuplicates(keys))
    parts, rounds, total = [delta], 0, n
    while n:
        if rounds >= max_rounds:
            raise NotConverged(f"no fixpoint after {rounds} rounds")
        known = one_partition(union(parts), total)
        # only tables whose size is known are put in one partition: a step also scans relations of any size
        few = getattr(step, "few", step) if n <= SMALL else step
        found = few(light(delta, n), known).select(columns).dropDuplicates(keys)
        delta, n = unknown(found, known, keys, total, n)
        total += n
        if n:
            parts.append(delta)
        if len(parts) > PARTS:
            parts = [stored(union(parts))]
        rounds += 1
    return one_partition(union(parts), total)


def repeated(hop: Callable[[DataFrame], DataFrame], times: int = 3, over: int = 0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A step that takes a linear rule several times in one job, so fewer rounds are written.

    over: rows of the relation that the rule joins with. A few new rows are sent to a large one, once a round,
    as what comes of them may be too much to send.
    """

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        found, last = [], delta
        for _ in range(times):
            last = hop(last).distinct()
            found.append(last)
        return union(found)

    if over > LARGE:
        step.few = lambda delta, known: hop(delta)
    return step
