"""Call-graph construction at several levels of precision.

Inputs are relations, from a program's facts or a projection:
  func(f, ret, full_type, nargs, is_stub, is_library), entry(f), alloc(f, c),
  site(s, f, kind, i, target, nargs, ret, full_type) with kind one of `named` (target), `dynamic`
  (index i), `value` (a function value), index_method(i, m), method_class(m, c).
Results are edges (s, src, dst).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import PARTS, NotConverged, fixpoint, repeated, union
from ..plans.store import counted, stored
from .dispatch import targets
from .graphs import components, reachable

# Names of functions that are no analysis entries.
DULL_SUFFIXES = (".deinit", ".deinit!deallocator.foreign", ".modify", ".__deallocating_deinit")
CLOSURE_PREFIXES = ("closure ", "reabstraction thunk")

EDGE = ["s", "src", "dst"]


def is_dull(name, is_library, libraries: bool = False):
    """Functions whose own analysis tells nothing."""
    out = F.lit(False)
    for suffix in DULL_SUFFIXES:
        out = out | name.endswith(suffix)
    return out if libraries else out | is_library


def is_closure(name):
    out = F.lit(False)
    for prefix in CLOSURE_PREFIXES:
        out = out | name.startswith(prefix)
    return out


def entries(func: DataFrame, closures: bool = False, libraries: bool = False) -> DataFrame:
    """f: all functions but dull ones, and closures unless they are asked for."""
    keep = ~is_dull(F.col("name"), F.col("is_library"), libraries)
    if not closures:
        keep = keep & ~is_closure(F.col("name"))
    return func.where(keep).select("f")


def trivial(site: DataFrame, func: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """Edges of sites that name an existing function; callers(f) limits whose."""
    named = site.where("kind = 'named'")
    if callers is not None:
        named = named.join(callers, "f", "left_semi")
    return named.join(func.select(F.col("f").alias("target")), "target", "left_semi").select("s", F.col("f").alias("src"), F.col("target").alias("dst")).distinct()


def dispatched(site: DataFrame, index_method: DataFrame, method_class: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Edges of dynamic sites, by the classes there are."""
    return site.where("kind = 'dynamic'").join(targets(index_method, method_class, types), "i").select("s", F.col("f").alias("src"), F.col("m").alias("dst")).distinct()


def cha(site, func, index_method, method_class, callers: DataFrame | None = None) -> DataFrame:
    """Class hierarchy analysis."""
    some = site if callers is None else site.join(callers, "f", "left_semi")
    return trivial(some, func).unionByName(dispatched(some, index_method, method_class))


def prta(site, func, alloc, index_method, method_class) -> DataFrame:
    """Pessimistic rapid type analysis: types that the whole program instantiates."""
    return trivial(site, func).unionByName(dispatched(site, index_method, method_class, alloc.select("c").distinct()))


def orta(site, func, entry, alloc, index_method, method_class) -> DataFrame:
    """Optimistic rapid type analysis: types that reached functions instantiate.

    One relation holds reached functions and instantiated classes, tagged. Stubs have no calls.
    """
    body = func.where("not is_stub").select("f")
    named = stored(trivial(site.join(body, "f", "left_semi"), func))
    dynamic = stored(
        site.where("kind = 'dynamic'").join(body, "f", "left_semi").select("s", "f", "i").join(index_method, "i").join(method_class, "m").select("s", "f", "m", "c").distinct()
    )
    calls = named.select(F.col("src").alias("f"), F.col("dst").alias("m")).distinct()
    needs = dynamic.select("f", "c", "m").distinct()
    alloc = alloc.select("f", "c").distinct()

    def step(delta, known):
        new_f, new_c = (delta.where(F.col("tag") == t).select(F.col("n").alias(x)) for t, x in (("f", "f"), ("c", "c")))
        all_f, all_c = (known.where(F.col("tag") == t).select(F.col("n").alias(x)) for t, x in (("f", "f"), ("c", "c")))
        tagged = lambda df, col, t: df.select(F.lit(t).alias("tag"), F.col(col).alias("n"))
        return union(
            [
                tagged(new_f.join(alloc, "f"), "c", "c"),
                tagged(new_f.join(calls, "f"), "m", "f"),
                tagged(new_f.join(needs, "f").join(all_c, "c", "left_semi"), "m", "f"),
                tagged(needs.join(new_c, "c", "left_semi").join(all_f, "f", "left_semi"), "m", "f"),
            ]
        )

    found = stored(fixpoint(entry.select(F.lit("f").alias("tag"), F.col("f").alias("n")), step))
    live = found.where("tag = 'f'").select(F.col("n").alias("f"))
    types = found.where("tag = 'c'").select(F.col("n").alias("c"))
    first = named.join(live.toDF("src"), "src", "left_semi")
    second = dynamic.join(live, "f", "left_semi").join(types, "c", "left_semi").select("s", F.col("f").alias("src"), F.col("m").alias("dst"))
    return first.select(EDGE).unionByName(second).distinct()


def signature_matches(site, func, edges, callers) -> DataFrame:
    """Edges for unresolved sites: functions of equal type, or else of equal arity and result.

    Edges are as many as sites times functions of their type, so they are neither shuffled nor held: which sites have
    an exact match is asked of the types, and only sites or functions with several types, whose edges may repeat, are
    made distinct.
    """
    left = site.where("kind <> 'named'").join(callers, "f", "left_semi").join(edges.select("s"), "s", "left_anti")
    several = F.count(F.lit(1)).over(Window.partitionBy("s")) > 1
    left = stored(left.select("s", "f", "full_type", "nargs", "ret").distinct().withColumn("several_s", several))
    several = F.count(F.lit(1)).over(Window.partitionBy("dst")) > 1
    types = stored(func.select(F.col("f").alias("dst"), "full_type", "nargs", "ret").distinct().withColumn("several_f", several))
    matched = left.join(types.select("full_type"), "full_type", "left_semi").select("s")
    columns = ["s", F.col("f").alias("src"), "dst", (F.col("several_s") | F.col("several_f")).alias("again")]
    exact = left.join(types.select("dst", "full_type", "several_f"), "full_type").select(*columns)
    loose = left.join(matched, "s", "left_anti").join(types.select("dst", "nargs", "ret", "several_f"), ["nargs", "ret"]).select(*columns)
    found = exact.unionByName(loose)
    return found.where("not again").select(EDGE).unionByName(found.where("again").select(EDGE).distinct())


# --- value flow ------------------------------------------------------------------------------


def reaching(seed: DataFrame, edge: DataFrame) -> DataFrame:
    """node, what, kind: which seeds reach each node, all seeds at once."""
    edge = stored(edge.select("src", "dst").distinct())
    hop = repeated(lambda d: d.join(edge.toDF("node", "to"), "node").select(F.col("to").alias("node"), "what", "kind"))
    return fixpoint(seed.select("node", "what", "kind"), hop)


def value_edges(stmt, arg, ret, param, calls) -> DataFrame:
    """src, dst over symbols `func.sym` and field names: assignments, loads, stores, arguments and results.

    stmt(stmt_id, func, kind, result, src, obj, field); arg(stmt_id, idx, sym); ret(func, sym);
    param(func, idx, sym); calls(s, src, dst) resolves sites conservatively. For initialisers of views
    the last argument flows to the result.
    """
    sym = lambda f, s: F.concat_ws(".", f, s)
    field = lambda f: F.concat(F.lit("field "), f)
    func = F.col("func")
    parts = [
        stmt.where("kind = 'assign'").select(sym(func, F.col("src")).alias("src"), sym(func, F.col("result")).alias("dst")),
        stmt.where("kind = 'field_read'").select(field(F.col("field")).alias("src"), sym(func, F.col("result")).alias("dst")),
        stmt.where("kind = 'field_write'").select(sym(func, F.col("src")).alias("src"), field(F.col("field")).alias("dst")),
    ]
    site = stmt.where("kind = 'apply'").select(F.col("stmt_id").alias("s"), F.col("func").alias("caller"), F.col("result").alias("res"))
    sites = site.join(calls.select("s", "dst"), "s")
    parts.append(sites.join(ret.toDF("dst", "val"), "dst").select(sym(F.col("dst"), F.col("val")).alias("src"), sym(F.col("caller"), F.col("res")).alias("dst")))
    args = sites.join(arg.select(F.col("stmt_id").alias("s"), "idx", "sym"), "s")
    to = param.select(F.col("func").alias("dst"), "idx", F.col("sym").alias("p"))
    parts.append(args.join(to, ["dst", "idx"]).select(sym(F.col("caller"), F.col("sym")).alias("src"), sym(F.col("dst"), F.col("p")).alias("dst")))
    last = args.where(F.col("dst") == "#UIView.init!initializer.foreign").groupBy("s", "caller", "res").agg(F.max_by("sym", "idx").alias("sym"))
    parts.append(last.select(sym(F.col("caller"), F.col("sym")).alias("src"), sym(F.col("caller"), F.col("res")).alias("dst")))
    return union(parts).distinct()


def value_seeds(stmt) -> DataFrame:
    """node, what, kind: allocations and references at the symbols that they define."""
    node = F.concat_ws(".", "func", "result")
    kinds = {"new": ("class", "alloc_type"), "function_ref": ("func", "fn_name"), "builtin_ref": ("func", "fn_name"), "dynamic_ref": ("index", "fn_index")}
    return union([stmt.where(F.col("kind") == k).select(node.alias("node"), F.col(c).alias("what"), F.lit(t).alias("kind")) for k, (t, c) in kinds.items()]).distinct()


def vta(site, func, flows, index_method, method_class) -> DataFrame:
    """Variable type analysis over flows(node, what, kind).

    site has, besides, recv (the node of the last argument) and fnode (the node of the function value).
    Named sites are trivial; dynamic ones take the classes that reach the receiver; function values
    what reaches them, if arity and result type agree.
    """
    cls = flows.where("kind = 'class'").select(F.col("node").alias("recv"), F.col("what").alias("c"))
    fun = flows.where("kind = 'func'").select(F.col("node").alias("fnode"), F.col("what").alias("dst"))
    by_class = site.where("kind = 'dynamic'").join(index_method, "i").join(method_class, "m").join(cls, ["recv", "c"], "left_semi")
    by_value = site.where("kind = 'value'").select("s", "f", "fnode", "nargs", "ret").join(fun, "fnode")
    by_value = by_value.join(func.select(F.col("f").alias("dst"), "nargs", "ret"), ["dst", "nargs", "ret"])
    return union(
        [
            trivial(site, func),
            by_class.select("s", F.col("f").alias("src"), F.col("m").alias("dst")),
            by_value.select("s", F.col("f").alias("src"), "dst"),
        ]
    ).distinct()


# --- unified, flow-sensitive -----------------------------------------------------------------


#: Blocks of a function are numbered below this, so a function's and a block's number make one.
BLOCKS = 1 << 24
#: Ways times words up to which every node holds its whole set: finding what comes after the largest node takes longer. The answers are the same.
WHOLE = 2_000_000


def passing(block_edge: DataFrame, exits: DataFrame) -> DataFrame:
    """n: blocks on a way from the first block of their function to one that it is left from; block_edge(src, dst) and exits(n) are of block numbers."""
    ahead = stored(block_edge.toDF("n", "to"))
    firsts = exits.select((F.col("n") - F.pmod("n", F.lit(BLOCKS))).alias("n")).distinct()
    after = fixpoint(firsts, repeated(lambda d: d.join(ahead, "n").select(F.col("to").alias("n"))))
    inside = stored(ahead.join(after, "n", "left_semi"))
    return fixpoint(exits.join(after, "n", "left_semi"), repeated(lambda d: d.withColumnRenamed("n", "to").join(inside, "to").select("n")))


def largest(label: DataFrame):
    """The node that most blocks of label(n, root) are merged into, or None; of equal ones the least."""
    first = label.groupBy("root").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "root").first()
    return None if first is None else first.root


def spread_bits(sets: DataFrame, edge: DataFrame, below: DataFrame, shared: DataFrame) -> DataFrame:
    """root, w, bits: words of sets, with all that comes over edge(src, dst) of roots.

    Nodes below(root) hold the words shared(w, every), too; of theirs only other bits are made. below is closed under edge.
    """
    mark = below.select("root", F.lit(True).alias("below"))
    near = stored(edge.toDF("from", "root").join(mark, "root", "left").select(F.col("from").alias("root"), F.col("root").alias("to"), "below"))

    def own(df: DataFrame) -> DataFrame:
        rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.when(F.col("below"), F.col("every")), F.lit(0).cast("long"))))
        return df.join(shared, "w", "left").withColumn("bits", rest).where("bits <> 0")

    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy("root", "w").agg(F.bit_or("bits").alias("bits"))

    known, n = counted(merged(own(sets.join(mark, "root", "left"))))
    new = known
    while n:
        hops, last = [], new
        for _ in range(3):
            last = merged(own(last.join(near, "root").select(F.col("to").alias("root"), "w", "bits", "below")))
            hops.append(last)
        had = known.withColumnRenamed("bits", "had")
        fresh = merged(union(hops)).join(had, ["root", "w"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))))
        new, n = counted(fresh.where("bits <> 0").select("root", "w", "bits"))
        if n:
            known = stored(merged(known.unionByName(new)))
    return known


def ucg(
    site, func, entry, alloc, index_method, method_class, block_edge=None, flows: DataFrame | None = None, points_to: DataFrame | None = None, exits: DataFrame | None = None, max_rounds: int = 1000
) -> DataFrame:
    """Unified call graph: classes that may exist on leaving each block, and edges, in one fixpoint.

    site, alloc have a block; block_edge(f, src, dst) orders blocks, 0 the first of a function;
    exits(f, block) are the blocks a function is left from (those without successor, if not given).
    flows(node, what, kind) narrows receivers to classes that reach them (site.recv); points_to(s, dst)
    resolves function values. Functions and classes are numbers.

    A call passes what exists to its target and gets back what exists where that is left. So a calling
    block and all blocks on the ways through its target are on one cycle and have one set of classes:
    they are merged into one node, by connected components, and sets are kept for nodes, as 64-bit
    words. What is left between nodes is the order of blocks that no call closes to a cycle. Each
    round merges what its new edges close and spreads sets to the end. What comes after the largest node
    holds all classes of that one: these are kept once, and only others for each node.
    """
    if block_edge is None:
        block_edge = site.sparkSession.createDataFrame([], "f long, src int, dst int")
    block_edge = stored(block_edge.select("f", "src", "dst").distinct())
    if exits is None:
        blocks = union([site.select("f", "block"), alloc.select("f", "block"), block_edge.select("f", F.col("dst").alias("block")), func.select("f", F.lit(0).alias("block"))]).distinct()
        exits = blocks.join(block_edge.select("f", F.col("src").alias("block")), ["f", "block"], "left_anti")
    number = lambda f, block: (F.col(f).cast("long") * BLOCKS + block).alias("n")
    exits = stored(exits.select(number("f", F.col("block"))).distinct())
    nexts = stored(block_edge.select(number("f", F.col("src")).alias("src"), number("f", F.col("dst")).alias("dst")))
    through = passing(nexts, exits)
    through = stored(through.select("n", F.floor(F.col("n") / BLOCKS).cast("long").alias("m"), (F.pmod("n", F.lit(BLOCKS)) == 0).alias("first")))
    left_only = stored(exits.join(through, "n", "left_anti").select("n", F.floor(F.col("n") / BLOCKS).cast("long").alias("m")))
    # classes as 64-bit words: word c div 64 of a block's set, bit c mod 64
    word, bit = F.floor(F.col("c") / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("c"), F.lit(64)).cast("int"))
    sets = stored(alloc.select(number("f", F.col("block")), word.alias("w"), bit.alias("bits")).groupBy("n", "w").agg(F.bit_or("bits").alias("bits")))
    possible = site.where("kind = 'dynamic'").join(index_method, "i").join(method_class, "m")
    if flows is not None:
        cls = flows.where("kind = 'class'").select(F.col("node").alias("recv"), F.col("what").alias("c"))
        possible = possible.join(cls, ["recv", "c"], "left_semi")
    possible = stored(possible.select("s", "m", number("f", F.col("block")), word.alias("w"), bit.alias("bit")).distinct())
    fixed = trivial(site, func).select("s", F.col("dst").alias("m"))
    if points_to is not None:
        fixed = fixed.unionByName(points_to.select("s", F.col("dst").alias("m")))
    where = stored(site.select("s", "f", number("f", F.col("block"))).distinct())
    n_words = sets.select("w").distinct().count()
    label = None  # n, root of blocks that are merged; others are their own
    hub = below = above = None
    spark, none = site.sparkSession, stored(where.select(F.col("n").alias("f")).where("false"))
    new_edge, n_edges = counted(fixed.distinct())
    edges, ahead = [new_edge], [nexts]

    def named(df: DataFrame, *columns: str) -> DataFrame:
        """df with nodes in the place of blocks."""
        order = df.columns
        if label is not None:
            for c in columns:
                df = df.join(label.select(F.col("n").alias(c), F.col("root").alias("root_")), c, "left").withColumn(c, F.coalesce("root_", c)).select(*order)
        return df

    for _ in range(max_rounds):
        called = stored(new_edge.join(where, "s").select("n", "m").distinct())
        target = stored(called.select("m").distinct().join(through, "m"))
        back = stored(target.where("first").select("m"))  # functions that come back
        links = called.join(back, "m", "left_semi").select(F.col("n").alias("src"), number("m", F.lit(0)).alias("dst"))
        links = links.unionByName(target.where("not first").select(F.col("n").alias("src"), number("m", F.lit(0)).alias("dst")))
        one_way = called.join(back, "m", "left_anti").select(F.col("n").alias("src"), number("m", F.lit(0)).alias("dst"))
        ahead.append(stored(one_way.unionByName(called.withColumnRenamed("n", "dst").join(left_only, "m").select(F.col("n").alias("src"), "dst"))))
        links = stored(named(links, "src", "dst").where("src <> dst").distinct())
        joined = components(links.select(F.col("src").alias("n")), links)
        if label is None:
            label = stored(joined)
        else:  # a node that is merged takes its blocks with it
            moved = joined.toDF("root", "to")
            old = label.join(moved, "root", "left").select("n", F.coalesce("to", "root").alias("root"))
            label = stored(old.unionByName(joined.join(label.select("n"), "n", "left_anti").select("n", "root")))
        ways, n_ways = counted(named(union(ahead), "src", "dst").where("src <> dst").distinct())
        sets = stored(named(sets, "n").withColumnRenamed("n", "root"))
        had, hub = hub, largest(label) if n_ways * n_words > WHOLE else None
        if hub is None:
            below = above = none
        else:
            at = spark.range(hub, hub + 1).toDF("f")
            if had is not None and named(spark.range(had, had + 1).toDF("n"), "n").first().n == hub:  # ways are only added
                below, above = (at.union(named(x, "f")).distinct() for x in (below, above))
            else:
                below = above = at
            below, above = stored(reachable(below, ways)), stored(reachable(above, ways.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        under = below.withColumnRenamed("f", "root")
        shared = stored(sets.join(above.withColumnRenamed("f", "root"), "root", "left_semi").groupBy("w").agg(F.bit_or("bits").alias("every")))
        sets = spread_bits(sets, ways, under, shared)
        asked = stored(named(possible, "n").withColumnRenamed("n", "root"))
        hit = asked.join(sets, ["root", "w"]).where(F.col("bit").bitwiseAND(F.col("bits")) != 0).select("s", "m")
        hit = hit.unionByName(asked.join(under, "root", "left_semi").join(shared, "w").where(F.col("bit").bitwiseAND(F.col("every")) != 0).select("s", "m"))
        new_edge, n_edges = counted(hit.distinct().join(union(edges), ["s", "m"], "left_anti"))
        if not n_edges:
            break
        possible = stored(possible.join(new_edge, ["s", "m"], "left_anti"))
        sets = sets.withColumnRenamed("root", "n")
        if hub is not None:
            sets = sets.unionByName(shared.select(F.lit(hub).cast("long").alias("n"), "w", F.col("every").alias("bits")))
        edges.append(new_edge)
        if len(edges) > PARTS:
            edges, ahead = [stored(union(edges))], [stored(union(ahead))]
    else:
        raise NotConverged(f"no fixpoint after {max_rounds} rounds")
    return union(edges).join(where, "s").select("s", F.col("f").alias("src"), F.col("m").alias("dst"))


def by_queries(site, func, resolve: Callable[[DataFrame], DataFrame], index_method, method_class, mode: str = "none", alloc: DataFrame | None = None, receivers: DataFrame | None = None) -> DataFrame:
    """Repeat until no edge comes: resolve function values over the graph so far; dynamic sites once.

    mode: none (all classes), program (classes of alloc), query (receivers(s, c))
    """
    if mode == "query":
        dyn = site.where("kind = 'dynamic'").join(index_method, "i").join(method_class, "m").join(receivers, ["s", "c"], "left_semi").select("s", F.col("f").alias("src"), F.col("m").alias("dst")).distinct()
    else:
        dyn = dispatched(site, index_method, method_class, alloc.select("c").distinct() if mode == "program" else None)
    edges, n = counted(trivial(site, func).unionByName(dyn).distinct())
    while True:
        more, m = counted(edges.unionByName(resolve(edges).select(EDGE)).distinct())
        if m == n:
            return more
        edges, n = more, m


# --- statistics ------------------------------------------------------------------------------


def resolution(site, edges) -> DataFrame:
    """One row: sites, resolved, unresolved, and unresolved that could be resolved by no name."""
    hit = edges.select("s").distinct().withColumn("hit", F.lit(True))
    open_ = F.col("hit").isNull()
    return site.join(hit, "s", "left").agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if(F.col("hit")).alias("resolved"),
        F.count_if(open_).alias("unresolved"),
        F.count_if(open_ & (F.col("kind") != "named")).alias("truly_unresolved"),
    )


def method_stats(func, alloc) -> DataFrame:
    """One row: methods and allocations, all and outside libraries."""
    a = alloc.join(func.select("f", "is_library"), "f")
    one = func.agg(F.count(F.lit(1)).alias("methods"), F.count_if(~F.col("is_library")).alias("user_methods"))
    return one.crossJoin(a.agg(F.count(F.lit(1)).alias("allocations"), F.count_if(~F.col("is_library")).alias("user_allocations")))  # one row each


def nontrivial_flow(stmt, arg) -> DataFrame:
    """kind, n: values that are passed on, stored in fields, or defined more than once."""
    made = stmt.where(F.col("kind").isin("new", "function_ref", "dynamic_ref")).select("func", "kind", F.col("result").alias("sym"))
    passed = arg.join(stmt.select("stmt_id", "func"), "stmt_id").select("func", "sym")
    kept = stmt.where("kind = 'field_write'").select("func", F.col("src").alias("sym"))
    many = stmt.where("result is not null").groupBy("func", F.col("result").alias("sym")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("func", "sym")
    hits = union([made.join(x.distinct(), ["func", "sym"], "left_semi") for x in (passed, kept, many)]).distinct()
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
