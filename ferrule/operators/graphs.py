"""Reachability, closures, paths, components and comparisons of call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import fixpoint, repeated
from ..plans.store import counted, stored


def reachable(entry: DataFrame, edge: DataFrame) -> DataFrame:
    """f: what the entries reach over edge(src, dst)."""
    edge, rows = counted(edge.select("src", "dst").distinct())
    hop = repeated(lambda d: d.join(edge.toDF("f", "to"), "f").select(F.col("to").alias("f")), over=rows)
    return fixpoint(entry.select("f"), hop)


def closure(edge: DataFrame) -> DataFrame:
    """src, dst: the transitive closure, by doubling: paths of n edges join paths of n edges or fewer."""

    def step(delta, known):
        left = delta.toDF("src", "mid").join(known.toDF("mid", "dst"), "mid").select("src", "dst")
        right = known.toDF("src", "mid").join(delta.toDF("mid", "dst"), "mid").select("src", "dst")
        return left.unionByName(right)

    return fixpoint(edge.select("src", "dst"), step)


def shortest_paths(entry: DataFrame, edge: DataFrame) -> DataFrame:
    """f, dist, prev: breadth-first levels with the least predecessor on a shortest path; null at entries."""
    edge = stored(edge.select("src", "dst").distinct())
    kind = dict(edge.dtypes)["src"]
    seed = entry.select("f").distinct().select("f", F.lit(0).alias("dist"), F.lit(None).cast(kind).alias("prev"))

    def step(delta, known):
        hop = delta.select("f", "dist").join(edge.toDF("f", "to"), "f").groupBy(F.col("to"))
        return hop.agg((F.min("dist") + 1).alias("dist"), F.min("f").alias("prev")).withColumnRenamed("to", "f")

    return fixpoint(seed, step, keys=["f"])


def path_to(levels: DataFrame, target) -> DataFrame:
    """step, f: the path that shortest_paths found to a target, from its end."""
    end = levels.where(F.col("f") == F.lit(target)).select("f", "dist", "prev")
    return fixpoint(end, lambda d, _: levels.join(d.select(F.col("prev").alias("f")), "f").select("f", "dist", "prev"), keys=["f"]).select(
        F.col("dist").alias("step"), "f"
    )


def components(node: DataFrame, edge: DataFrame) -> DataFrame:
    """n, root: the least node of each node's connected component.

    Each round all nodes of one label go over to the least label beside any of them, then pointers jump.
    """
    both = edge.select("src", "dst").union(edge.select("dst", "src")).where("src <> dst").distinct()
    both = stored(both)
    ends = node.select(F.col(node.columns[0]).alias("n"))
    label = stored(ends.union(both.select("src")).distinct().select("n", F.col("n").alias("root")))
    while True:
        near = both.join(label.toDF("dst", "theirs"), "dst").groupBy("src").agg(F.min("theirs").alias("theirs"))
        beside = label.join(near.toDF("n", "theirs"), "n", "left").groupBy("root").agg(F.min("theirs").alias("theirs"))
        lower = stored(label.join(beside, "root").select("n", F.col("root").alias("old"), F.least("root", F.coalesce("theirs", "root")).alias("root")))
        jump = lower.join(lower.select("n", "root").toDF("root", "next"), "root").select("n", "old", F.col("next").alias("root"))
        label, _ = counted(jump)
        if label.where("root <> old").isEmpty():
            return label.select("n", "root")
        label = label.select("n", "root")


def prune_entries(entry: DataFrame, edge: DataFrame) -> DataFrame:
    """The entries that nothing calls."""
    return entry.join(edge.select(F.col("dst").alias("f")), "f", "left_anti")


def dead(func: DataFrame, entry: DataFrame, edge: DataFrame) -> DataFrame:
    """f, state: functions without callers are entries or dead."""
    alone = func.select("f").join(edge.select(F.col("dst").alias("f")), "f", "left_anti")
    known = entry.select("f", F.lit(True).alias("is_entry")).distinct()
    return alone.join(known, "f", "left").select("f", F.when(F.col("is_entry"), "entry").otherwise("dead").alias("state"))


def graph_info(entry: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: numbers of entries, edges, methods, reachable methods and reachable edges."""
    reach = stored(reachable(entry, edge))
    nodes = all_nodes(entry, edge)
    live = edge.join(reach.select(F.col("f").alias("src")), "src", "left_semi")
    parts = [("entries", entry.select("f").distinct()), ("edges", edge), ("methods", nodes), ("reachable", reach), ("reachable_edges", live)]
    one = None
    for name, df in parts:
        n = df.agg(F.count(F.lit(1)).alias(name))
        one = n if one is None else one.crossJoin(n)  # each side is one row
    return one


def all_nodes(entry: DataFrame, edge: DataFrame) -> DataFrame:
    return entry.select("f").union(edge.select("src")).union(edge.select("dst")).distinct()


def context_insensitive(edge: DataFrame) -> DataFrame:
    """src, dst without contexts and weights."""
    return edge.select("src", "dst").distinct()


def difference(super_entry, super_edge, sub_entry, sub_edge, ignore_entry: bool = False, only_missing_targets: bool = False) -> DataFrame:
    """kind, src, dst: entries and edges of the larger graph that the smaller lacks, if the source is reachable there."""
    reach = stored(reachable(sub_entry, sub_edge))
    live = reach.select(F.col("f").alias("src"))
    edges = context_insensitive(super_edge).subtract(context_insensitive(sub_edge)).join(live, "src", "left_semi")
    if only_missing_targets:
        edges = edges.join(reach.select(F.col("f").alias("dst")), "dst", "left_anti")
    out = edges.select(F.lit("edge").alias("kind"), "src", "dst")
    if not ignore_entry:
        more = super_entry.select("f").subtract(sub_entry.select("f"))
        kind = dict(super_edge.dtypes)["src"]
        out = more.select(F.lit("entry").alias("kind"), F.lit(None).cast(kind).alias("src"), F.col("f").alias("dst")).unionByName(out)
    return out


def missing_methods(super_entry, super_edge, sub_entry, sub_edge) -> DataFrame:
    """f: what only the larger graph reaches."""
    return reachable(super_entry, super_edge).subtract(reachable(sub_entry, sub_edge))


def site_kinds(edge: DataFrame) -> DataFrame:
    """context, n, poly: targets of each call site."""
    n = F.count_distinct("dst")
    return edge.groupBy("context").agg(n.alias("n"), (n > 1).alias("poly"))


def diff_stats(super_edge: DataFrame, sub_edge: DataFrame, sub_entry: DataFrame) -> DataFrame:
    """before, after, n: how call sites change between mono, poly, absent and unreachable."""
    reach = stored(reachable(sub_entry, sub_edge))
    live = sub_edge.join(reach.select(F.col("f").alias("src")), "src", "left_semi").select("context").distinct().withColumn("live", F.lit(True))

    def named(df, name):
        return site_kinds(df).select("context", F.when(F.col("poly"), "poly").otherwise("mono").alias(name))

    both = named(super_edge, "before").join(named(sub_edge, "after"), "context", "full_outer").join(live, "context", "left")
    after = F.when(F.col("after").isNull(), "absent").when(F.col("live").isNull(), F.concat("after", F.lit(" unreachable"))).otherwise(F.col("after"))
    return both.groupBy(F.coalesce("before", F.lit("absent")).alias("before"), after.alias("after")).agg(F.count(F.lit(1)).alias("n"))


def poly_precision(super_edge: DataFrame, sub_edge: DataFrame) -> DataFrame:
    """change, n: polymorphic sites whose targets the smaller graph narrows, widens or keeps."""

    def targets(df, name):
        return df.groupBy("context").agg(F.collect_set("dst").alias(name))

    both = targets(super_edge, "a").where(F.size("a") > 1).join(targets(sub_edge, "b"), "context", "left")
    b = F.coalesce("b", F.array().cast(dict(both.dtypes)["a"]))
    fewer, more = F.size(F.array_except("a", b)) > 0, F.size(F.array_except(b, F.col("a"))) > 0
    change = F.when(fewer & more, "other").when(fewer, "narrower").when(more, "wider").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def without_packages(edge: DataFrame, package, libraries: DataFrame) -> DataFrame:
    """Edges whose source and target lie outside the listed packages; package(f, package)."""
    drop = package.join(libraries, "package", "left_semi").select("f")
    for end in ("src", "dst"):
        edge = edge.join(drop.select(F.col("f").alias(end)), end, "left_anti")
    return edge


def by_weight(edge: DataFrame) -> DataFrame:
    """Edges by rising weight; ties are kept, in order of their ends."""
    return edge.orderBy("weight", "src", "dst")


def in_edges(edge: DataFrame, f) -> DataFrame:
    return edge.where(F.col("dst") == F.lit(f))


def out_edges(edge: DataFrame, f) -> DataFrame:
    return edge.where(F.col("src") == F.lit(f))


def search(func: DataFrame, text: str) -> DataFrame:
    """Functions whose name contains a text."""
    return func.where(F.col("name").contains(text))


def next_statement(stmt: DataFrame) -> DataFrame:
    """func, src, dst: each statement and the next of its block."""
    order = Window.partitionBy("func", "block_ord").orderBy("ord")
    return stmt.withColumn("dst", F.lead("stmt_id").over(order)).where(F.col("dst").isNotNull()).select("func", F.col("stmt_id").alias("src"), "dst")
