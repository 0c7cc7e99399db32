"""What grows with the input stays off the driver and out of single tasks."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import callgraph, flow, graphs, reach, unify, walk, witness
from ferrule.plans import fixpoint as fixpoint_module
from ferrule.plans import store
from ferrule.plans.fixpoint import fixpoint, repeated
from ferrule.plans.flow_queries import QUERIES
from ferrule.plans.text_queries import SPAN, module_texts
from ferrule.sources import ir_text, sil


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def limits(monkeypatch, small, large):
    for module in (store, fixpoint_module, flow, callgraph):
        for name, value in (("SMALL", small), ("LARGE", large)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)


def test_few_new_rows_are_joined_without_shuffling_large_relations(spark, monkeypatch):
    limits(monkeypatch, 10, 100)
    plans, written = [], fixpoint_module.counted
    monkeypatch.setattr(fixpoint_module, "counted", lambda df, small=False: plans.append(plan(df)) or written(df, small))
    edge, rows = store.counted(spark.range(380, 550).select("id", (F.col("id") + 1).alias("to")))
    step = repeated(lambda d: d.join(edge.toDF("n", "next"), "n").select(F.col("next").alias("n")), over=rows)
    known = fixpoint(spark.range(380, 545).toDF("n"), step)  # the first round finds three rows, the others one
    assert {r.n for r in known.collect()} == set(range(380, 551))
    assert "SortMergeJoin" in plans[1] and len(plans) > 4
    assert not any("SortMergeJoin" in p for p in plans[2:])


@pytest.mark.parametrize("small", [0, 5, 10_000])
def test_facts_of_nested_calls_are_the_naive_fixpoint(spark, monkeypatch, small):
    limits(monkeypatch, small, 3 * small)
    rng = random.Random(small)
    edges = {(f, str(rng.randrange(4)), str(rng.randrange(4))) for f in range(8) for _ in range(3)}
    calls = [(s, rng.randrange(8), str(rng.randrange(4)), rng.randrange(8), str(rng.randrange(2)), s % 5 == 0) for s in range(30)]
    edge = spark.createDataFrame([(f, a, b, "copy", None) for f, a, b in edges], "f long, a string, b string, op string, field string")
    args = spark.createDataFrame([(s, f, a, g, q) for s, f, a, g, q, _ in calls], "site long, f long, a string, g long, q string")
    rets = spark.createDataFrame([(s, f, "2", g, "3", deep) for s, f, _, g, _, deep in calls], "site long, f long, r string, g long, w string, deep boolean")
    seeds = spark.createDataFrame([(1, "0"), (5, "2")], "f long, v string")
    got = {(r.ef, r.eq, r.v) for r in flow.tabulate(seeds, *flow.named_values(edge, args, rets)).collect()}
    want = {(f, flow.MARK + v, v) for f, v in [(1, "0"), (5, "2"), *((f, "2") for _, f, *_ in calls)]} | {(g, q, q) for _, _, _, g, q, _ in calls}
    while True:
        more = {(f, q, b) for f, q, v in want for g, a, b in edges if (f, v) == (g, a)}
        more |= {(f, q, "2") for f, q, v in want for _, h, a, g, p, deep in calls if (f, v) == (h, a) and not deep and (g, p, "3") in want}
        if more <= want:
            break
        want |= more
    assert got == want


def test_large_relations_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(store, "SMALL", 10)
    monkeypatch.setattr(store, "LARGE", 100)
    big = store.stored(spark.range(1000).select("id", (F.col("id") + 1).alias("to")))
    few = spark.range(500, 600).toDF("id")
    assert "Broadcast" not in plan(few.join(big.toDF("id", "to"), "id"))
    assert "Broadcast" not in plan(few.join(big.select("id"), "id", "left_anti"))
    known = fixpoint(spark.range(0, 1000, 10).toDF("n"), lambda d, _: d.join(big.toDF("n", "to"), "n").select(F.col("to").alias("n")))
    assert "Broadcast" not in plan(few.toDF("n").join(known, "n"))
    assert known.count() == 1001
    small = store.stored(spark.range(50).toDF("id"))
    assert "Broadcast" in plan(few.join(small, "id"))


def test_readers_hold_one_function_at_a_time():
    ir = "ir_stage raw\n\n" + "func @`f` : $`Any` {\nbb0:\n  v = new $`Any`\n  return v\n}\n" * 3 + "func @`g` : $`Any` {\nbb0:\n  v = nothing\n"
    read = ir_text.each(ir, "m")
    assert [next(read).name for _ in range(3)] == ["f"] * 3
    with pytest.raises(ir_text.ParseError, match="m:21: unknown instruction nothing"):
        next(read)
    compiled = "sil_stage canonical\n\n" + "sil @h : $@convention(thin) () -> Int {\nbb0:\n  %0 = tuple ()\n  return %0 : $()\n}\n" * 2
    read = sil.each(compiled + "sil @bad : $@convention(thin) () -> Int {\nbb0:\n  %0 = no_such_thing %1\n}\n", "m")
    assert [next(read).name for _ in range(2)] == ["h", "h"]


def test_workers_hand_over_some_functions_at_a_time(spark):
    text = "ir_stage raw\n" + "".join(f"func @`f{i}` : $`Any` {{\nbb0:\n  v = new $`Any`\n  return v\n}}\n" for i in range(5 * ir_text.AT_ONCE))
    rows = ir_text.functions(spark.createDataFrame([("m", text)], "module string, text string"))
    sizes = rows.select("func").mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]].head(1) for b in batches), "n long").collect()
    assert rows.count() == 5 * ir_text.AT_ONCE and max(r.n for r in sizes) <= store.BATCH_ROWS


def test_texts_are_parsed_on_all_cores(spark):
    text = "func @`f` : $`Any` {\nbb0:\n  v = new $`Any`\n  return v\n}\n"
    made = spark.range(400).coalesce(1).select(F.concat(F.lit("m"), "id").alias("module"), F.lit("ir_stage raw\n" + text).alias("text"))
    compiled = made.withColumn("text", F.lit("sil_stage canonical\n\nsil @h : $@convention(thin) () -> Int {\nbb0:\n  %0 = tuple ()\n  return %0 : $()\n}\n"))
    for rows in (ir_text.functions(made), sil.parsed(compiled)):
        parts = rows.select("module", F.spark_partition_id().alias("part")).groupBy("part").agg(F.count_distinct("module").alias("n")).collect()
        assert sum(r.n for r in parts) == 400 and max(r.n for r in parts) < 100


def test_files_of_modules_are_bounded(spark):
    lines = spark.range(0, 4 * SPAN, 500).select(F.lit("m").alias("module"), F.col("id").alias("f"), F.lit("x").alias("text"))
    assert [len(r.text) for r in module_texts(lines, "").collect()] == [2 * SPAN // 500 - 1] * 4


def test_signature_matches_shuffle_no_edges(spark):
    site = spark.createDataFrame([(1, 9, "value", "A", 1, "R"), (1, 9, "value", "B", 1, "R"), (2, 9, "value", "A", 1, "R"), (3, 9, "value", "Z", 1, "R"), (3, 9, "value", "Y", 1, "R"), (4, 9, "named", "A", 1, "R"), (5, 9, "value", None, 1, "R")], "s long, f long, kind string, full_type string, nargs int, ret string")
    func = spark.createDataFrame([(20, "A", 1, "R"), (20, "B", 1, "R"), (21, "A", 2, "R"), (22, "C", 1, "R")], "f long, full_type string, nargs int, ret string")
    edges, callers = spark.createDataFrame([], "s long, src long, dst long"), spark.createDataFrame([(9,)], "f long")
    got = callgraph.signature_matches(site, func, edges, callers)
    assert sorted((r.s, r.dst) for r in got.collect()) == [(1, 20), (1, 21), (2, 20), (2, 21), (3, 20), (3, 22), (5, 20), (5, 22)]
    once = callgraph.signature_matches(site.where("s = 2"), func.where("f > 20"), edges, callers)
    once.write.format("noop").mode("overwrite").save()
    assert [(r.s, r.src, r.dst) for r in once.collect()] == [(2, 9, 21)]
    # the edges of a site and a function with one type each are made by the last join, without an aggregate above it
    top = once._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert top[0].startswith("Union") and not any("Aggregate" in line for line in top[1 : next(i for i, line in enumerate(top) if "Join Inner" in line)])


def test_classes_are_followed_again_by_their_roots(spark, monkeypatch):
    followed = []
    monkeypatch.setattr(unify, "components", lambda node, edge: followed.append(sorted(map(tuple, edge.collect()))) or graphs.components(node, edge))
    value, copy = spark.range(1, 9).toDF("n"), spark.createDataFrame([(1, 2), (7, 8)], "src long, dst long")
    access = spark.createDataFrame([(1, "x", 3), (2, "x", 4), (3, "y", 5), (4, "y", 6), (4, "z", 8)], "obj long, field string, n long")
    got = {r.n: r.root for r in unify.alias_classes(value, copy, access).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}
    assert followed == [[(1, 2), (7, 8)], [(3, 4)], [(5, 6)]]


def test_classes_of_the_largest_node_are_held_once(spark, monkeypatch):
    monkeypatch.setattr(callgraph, "WHOLE", 0)
    spread, held = callgraph.spread_bits, []
    monkeypatch.setattr(callgraph, "spread_bits", lambda *a: held.append((got := spread(*a)).count()) or got)
    make, chain = spark.createDataFrame, 12
    # 0 and 1 call each other; 2 and those after it never come back, so they hold what 0 does and one class of their own
    site = [(0, 0, "named", 0, 1, 0), (1, 1, "named", 0, 0, 0), *((f, f - 1, "named", 0, f, 0) for f in range(2, chain))]
    site += [(100 + f, f, "dynamic", 7, 0, 0) for f in (1, 3, chain - 1)]
    alloc = [(0, 0, c) for c in range(0, 6400, 64)] + [(f, 0, 1 + f) for f in range(2, chain)]
    got = callgraph.ucg(
        make(site, "s long, f long, kind string, i long, target long, block int"), make([(f,) for f in range(chain + 4)], "f long"), None, make(alloc, "f long, block int, c long"),
        make([(7, chain), (7, chain + 1), (7, chain + 2)], "i long, m long"), make([(chain, 640), (chain + 1, 4), (chain + 2, 63)], "m long, c long"), exits=make([(0, 0), (1, 0)], "f long, block int"),
    )
    dynamic = {(r.s, r.dst) for r in got.collect() if r.s >= 100}
    assert dynamic == {(101, chain), (103, chain), (103, chain + 1), (100 + chain - 1, chain), (100 + chain - 1, chain + 1)}
    assert max(held) <= 3 * chain


def test_ways_go_by_spans_and_not_to_what_leads_nowhere(spark, monkeypatch):
    rounds, rows = [], []

    def watched(seed, step, keys=None, **more):
        steps = []
        got = fixpoint(seed, lambda delta, known: steps.append(1) or step(delta, known), keys, **more)
        if keys == ["seed", "n"]:
            rounds.append(len(steps))
            rows.append(got.count())
        return got

    monkeypatch.setattr(witness, "fixpoint", watched)
    make, long = spark.createDataFrame, 40
    pairs = [(str(i), str(i + 1)) for i in range(long)] + [x for i in range(long // 2) for x in ((str(2 * i), f"x{i}"), (f"x{i}", f"y{i}"))]
    edges = make([(1, a, b, "copy", None) for a, b in pairs], "f long, a string, b string, op string, field string")
    args = make([], "site long, f long, a string, g long, q string")
    rets = make([], "site long, f long, r string, g long, w string, deep boolean")
    uses = make([(1, str(long), "rule", 7)], "f long, v string, name string, sink long")
    (got,) = witness.paths(make([("s", 1, "0")], "seed string, f long, v string"), uses, make([], "f long"), edges, args, rets).collect()
    assert (got.seed, got.sink, got.length, got.sanitized) == ("s", 7, long, False)
    assert [x.v for x in got.path] == [str(i) for i in range(long + 1)]
    assert rows == [long + 1] and rounds[0] <= long // 8 + 1


def test_ways_by_spans_are_those_of_single_steps(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(i, i + rng.choice([-9, -2, 0, 1, 2])) for i in range(10, 38) for _ in range(2)]
    rng.shuffle(pairs)
    move = spark.createDataFrame([(x, a, b) for x, (a, b) in enumerate(pairs)], "x long, src long, dst long")
    want = set()
    for seed in (0, 5, 30):
        known, front, dist = set(), {seed: None}, 0
        while front:
            known |= set(front)
            want |= {(seed, n, dist, x) for n, x in front.items()}
            dist += 1
            front = {b: min(x for x, (a, c) in enumerate(pairs) if c == b and a in front) for a, b in pairs if a in front and b not in known}
    ball, _ = witness.balls(move)
    got = witness.ways(spark.createDataFrame([(s, s) for s in (0, 5, 30)], "seed long, n long"), ball).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and max(w[2] for w in want) > 2 * witness.SPAN


def test_written_parts_of_facts_are_not_broadcast_together(spark, monkeypatch):
    """Each function of a chain calls the next one, so each round adds a part to the facts; together they are many."""
    limits(monkeypatch, 0, 4)
    lines, written = [], flow.counted

    def watched(df, small=False):
        lines.extend(plan(df).splitlines())
        return written(df, small)

    monkeypatch.setattr(flow, "counted", watched)
    monkeypatch.setattr(fixpoint_module, "counted", watched)
    n = 6
    edges = spark.range(n).selectExpr("id f", f"if(id = {n - 1}, '0', '1') a", "'3' b", "'copy' op", "cast(null as string) field")
    args = spark.range(n - 1).selectExpr("id site", "id f", "'0' a", "id + 1 g", "'0' q")
    rets = spark.range(n - 1).selectExpr("id site", "id rf", "'3' r", "id + 1 rg", "'3' w", "false deep")
    known, edge, rows = flow.passed_through(flow.guarded_edges(edges), store.stored(args), store.stored(rets))
    assert known.count() == 2 * (n - 1) and rows == 2 * n - 1
    sent = [below for line, below in zip(lines, lines[1:]) if "BroadcastExchange" in line]
    assert any("Union" in line for line in lines) and not any("Union" in line for line in sent)


def plain_program(spark, seed, n=12, calls=26):
    """seeds, uses and relations of functions without fields, at random, with recursion and a chain of nested calls."""
    rng = random.Random(seed)
    edges = {(f, str(rng.randrange(4)), str(rng.randrange(4))) for f in range(n) for _ in range(3)} | {(n + i, "0", "3") for i in range(8)}
    call = [(s, rng.randrange(n), str(rng.randrange(4)), rng.randrange(n), str(rng.randrange(2)), s % 7 == 0) for s in range(calls)]
    call += [(100 + i, n + i, "0", n + i + 1, "0", False) for i in range(8)]
    make = spark.createDataFrame
    return (
        make([(f"s{i}", f"r{i % 2}", rng.randrange(n + 2), str(rng.randrange(4))) for i in range(9)] + [("s0", "r0", n, "0")], "seed string, name string, f long, v string"),
        make([(f"r{i % 2}", i % 7, rng.randrange(n + 9), str(rng.randrange(4))) for i in range(16)], "name string, sink long, f long, v string"),
        make([(f, a, b, "copy", None) for f, a, b in edges], "f long, a string, b string, op string, field string"),
        make([(s, f, a, g, q) for s, f, a, g, q, _ in call if s % 5], "site long, f long, a string, g long, q string"),
        make([(s, f, "2", g, "3", deep) for s, f, _, g, _, deep in call if s % 6], "site long, f long, r string, g long, w string, deep boolean"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_flow_held_by_one_task_is_that_of_rounds(spark, monkeypatch, seed):
    given = plain_program(spark, seed)
    read = lambda: sorted((r.seed, r.name, r.sink) for r in flow.flows_into(*given).collect())
    held = read()
    monkeypatch.setattr(flow, "HELD", 0)
    sent = read()
    monkeypatch.setattr(reach, "SENT", 0)
    assert held == sent == read() and held and len(set(held)) == len(held)
    back = given[:2] + flow.reversed_flow(*given[2:])
    rounds = sorted((r.seed, r.name, r.sink) for r in flow.flows_into(*back).collect())
    monkeypatch.undo()
    assert rounds == sorted((r.seed, r.name, r.sink) for r in flow.flows_into(*back, demand=True).collect())


def test_flow_without_fields_takes_no_rounds(spark, monkeypatch):
    """A chain of returns to callers that were not entered: each function calls the one before it."""

    def no_rounds(*given, **more):
        raise AssertionError("a round was taken")

    for module in (flow, reach):
        monkeypatch.setattr(module, "fixpoint", no_rounds)
    n = 300
    edges = spark.range(n).selectExpr("id f", "'2' a", "'3' b", "'copy' op", "cast(null as string) field")
    args = spark.range(1, n).selectExpr("id site", "id f", "'0' a", "id - 1 g", "'0' q")
    rets = spark.range(1, n).selectExpr("id site", "id f", "'2' r", "id - 1 g", "'3' w", "false deep")
    seeds = spark.range(1).selectExpr("'s' seed", "id f", "'2' v")
    uses = spark.range(n).selectExpr("id sink", "id f", "'2' v")
    assert sorted(r.sink for r in flow.flows_into(seeds, uses, edges, args, rets, demand=True).collect()) == list(range(n))
    assert flow.flows_into(seeds, uses.where("id < 0"), edges, args, rets).count() == 0


@pytest.mark.parametrize("rows", [1, 4, 1 << 18])
def test_what_starts_reach_is_handed_over_in_parts(spark, monkeypatch, rows):
    """Starts that share a node or have several, targets that share or have several, cycles; each pair once."""
    rng = random.Random(rows)
    edge = {(rng.randrange(30), rng.randrange(30)) for _ in range(40)}
    start = {(f"s{i % 12}", rng.randrange(34)) for i in range(16)} | {("a", 3), ("b", 3), ("c", 3)}
    target = {(i % 9, rng.randrange(34)) for i in range(14)}
    to = {n: {n} for n in range(34)}
    for _ in range(34):
        for a, b in edge:
            for seen in to.values():
                if a in seen:
                    seen.add(b)
    make = spark.createDataFrame
    monkeypatch.setattr(walk, "ROWS", rows)
    monkeypatch.setattr(walk, "AT_ONCE", 60)
    got = walk.walked(make(sorted(start), "seed string, n long"), make(sorted(target), "sink long, n long"), make(sorted(edge), "src long, dst long")).collect()
    want = {(s, t) for s, a in start for t, b in target if b in to[a]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("name", ["taint_args", "taint_backward", "taint_demanded", "taint_forward", "taint_sanitized"])
def test_taint_queries_take_no_rounds(spark, monkeypatch, name):
    def no_rounds(*given, **more):
        raise AssertionError("a round was taken")

    for module in (flow, reach):
        monkeypatch.setattr(module, "fixpoint", no_rounds)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
