"""Questions about where values come from, as trees compiled to joins.

A node holds at call sites; a tree holds at the sites where its root and all dependencies do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class CallSite:
    """Calls of functions that match a pattern; dependencies concern argument arg, or any if None."""

    pattern: str
    arg: int | None = None
    needs: list = field(default_factory=list)


@dataclass
class TypeDependency:
    """All, or with `some` at least one, allocations that reach the argument have a type that matches."""

    pattern: str
    some: bool = False


@dataclass
class CallSiteReturn:
    """The result of a call that the inner tree accepts reaches the argument."""

    site: CallSite


def ask(node: CallSite, calls: DataFrame, origin: DataFrame) -> DataFrame:
    """s, positions: the sites at which a tree holds, with the sites that contributed.

    calls(s, callee); origin(s, arg, kind, type, from_site): what reaches each argument, kind one of
    `allocation` (type) and `result` (from_site).
    """
    base = calls.where(F.col("callee").rlike(f"^(?:{node.pattern})$")).select("s").distinct().withColumn("positions", F.array(F.col("s")))
    given = origin if node.arg is None else origin.where(F.col("arg") == node.arg)
    for need in node.needs:
        if isinstance(need, TypeDependency):
            ok = F.col("type").rlike(f"^(?:{need.pattern})$")
            fold = F.bool_or(ok) if need.some else F.bool_and(ok)
            hit = given.where("kind = 'allocation'").groupBy("s").agg(fold.alias("ok")).where("ok").select("s")
            base = base.join(hit, "s", "left_semi")
        else:
            inner = ask(need.site, calls, origin).select(F.col("s").alias("from_site"), F.col("positions").alias("more"))
            hit = given.where("kind = 'result'").join(inner, "from_site").groupBy("s").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("more")))).alias("more"))
            base = base.join(hit, "s").select("s", F.array_sort(F.array_union("positions", "more")).alias("positions"))
    return base
