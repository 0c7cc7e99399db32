"""Operators on small inputs with known results, and properties."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.operators import annotations, callgraph, crypto, graphs, merge, query_engine, reports, typestate, unify, weights
from ferrule.plans.fixpoint import NotConverged, fixpoint
from ferrule.sources import probe, specs, summaries
from ferrule import streaming


def pairs(spark, rows, names="src, dst"):
    a, b = names.split(", ")
    return spark.createDataFrame(rows, f"{a} long, {b} long")


EDGE = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=14)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGE)
def test_closure_is_the_naive_fixpoint(spark, rows):
    want = set(rows)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in graphs.closure(pairs(spark, rows)).collect()} == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGE)
def test_reachability_grows_with_edges(spark, rows):
    entry = spark.createDataFrame([(0,)], "f long")
    some = {r.f for r in graphs.reachable(entry, pairs(spark, rows[: len(rows) // 2])).collect()}
    every = {r.f for r in graphs.reachable(entry, pairs(spark, rows)).collect()}
    assert some <= every


def test_rounds_are_never_cut_silently(spark):
    seed = spark.createDataFrame([(0,)], "n long")
    with pytest.raises(NotConverged):
        fixpoint(seed, lambda d, _: d.select((F.col("n") + 1).alias("n")), max_rounds=3)


def test_precision_chain(spark):
    rng = random.Random(5)
    site = spark.createDataFrame([(s, s % 6, "dynamic", rng.randrange(4), None) for s in range(30)], "s long, f long, kind string, i long, target long")
    func = spark.createDataFrame([(f, False) for f in range(20)], "f long, is_stub boolean")
    im = {(i, rng.randrange(20)) for i in range(4) for _ in range(4)}
    mc = {(m, rng.randrange(5)) for _, m in im}
    index_method, method_class = spark.createDataFrame(sorted(im), "i long, m long"), spark.createDataFrame(sorted(mc), "m long, c long")
    alloc = spark.createDataFrame([(0, 1), (3, 2)], "f long, c long")
    entry = spark.createDataFrame([(0,)], "f long")
    sets = [
        {tuple(r) for r in g.collect()}
        for g in (
            callgraph.orta(site, func, entry, alloc, index_method, method_class),
            callgraph.prta(site, func, alloc, index_method, method_class),
            callgraph.cha(site, func, index_method, method_class),
        )
    ]
    assert sets[0] <= sets[1] <= sets[2]


@pytest.mark.parametrize("state", ["none", "stub", "coroutine", "linked", "modelOverride", "model"])
@pytest.mark.parametrize("attr", ["none", "stub", "model", "coroutine", "other"])
def test_merge_matrix(spark, state, attr):
    # ways to reach each state from nothing
    way = {"none": ["none"], "stub": ["stub"], "coroutine": ["coroutine"], "linked": ["none", "stub"], "modelOverride": ["none", "model"], "model": ["stub", "model"]}[state]
    rows = [("f", i, a) for i, a in enumerate([*way, attr])]
    got = merge.merged(spark.createDataFrame(rows, "func string, ord long, attr string")).first()
    want = merge.MERGE.get((state, attr))
    assert got.state == (want[0] if want else "error")
    if want and want[1]:
        assert got.body == len(way)
    if want is None:
        with pytest.raises(merge.MergeConflict):
            merge.checked(merge.merged(spark.createDataFrame(rows, "func string, ord long, attr string")))


def test_a_model_alone_is_left_out(spark):
    assert merge.merged(spark.createDataFrame([("f", 0, "model")], "func string, ord long, attr string")).count() == 0


MOVES = [("closed", "open", "opened"), ("opened", "close", "closed"), ("closed", "read", "error")]


def test_traces_fold_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(o, k, rng.choice(["open", "close", "read", "noise"])) for o in range(5) for k in range(1, 40)]
    want = {}
    step = {(a, e): b for a, e, b in MOVES}
    for o, k, e in rows:
        s, at = want.get(o, ("closed", None))
        new = step.get((s, e), s)
        want[o] = (new, k if new != s else at)
    monkeypatch.setattr(typestate, "PIECE", 7)
    got = typestate.final_states(spark.createDataFrame(rows, "obj long, ord long, event string"), MOVES, "closed").collect()
    assert {r.obj: (r.state, r.changed) for r in got} == want


def test_program_states_follow_calls(spark):
    # main: 1 make, 2 call helper, 3 read; helper: 10 close, 11 return
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = typestate.program_states(
        s([("o", "main", "1")], "seed string, func string, stmt string"),
        s([("o", "10", "close"), ("o", "3", "read")], "seed string, stmt string, method string"),
        s([("1", "2"), ("2", "3"), ("3", "4"), ("10", "11")], "src string, dst string"),
        s([("2", "helper")], "stmt string, g string"),
        s([("helper", "10")], "g string, stmt string"),
        s([("helper", "11")], "g string, stmt string"),
        s([("opened", "close", "closed"), ("closed", "read", "error")], "src string, method string, dst string"),
        "opened",
    )
    assert {(r.stmt, r.state, r.changed) for r in found.collect()} == {("2", "opened", None), ("10", "opened", None), ("11", "closed", "10"), ("3", "closed", "10"), ("4", "error", "3")}


def test_nearest_filter(spark):
    got = spark.createDataFrame([(v,) for v in (0, 136, 137, 3000, 10**6)], "v long").select(typestate.nearest_filter(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [16, 16, 256, 4096, 65536]


def test_machines():
    for make in typestate.MACHINES.values():
        moves, states, initial = make()
        names = {n for n, _ in states}
        assert initial in names and {a for a, _, _ in moves} | {b for _, _, b in moves} <= names
        assert any(e for _, e in states) and not dict(states)[initial]
    assert sum(e for _, e in typestate.standard_machine()[1]) == 10


def test_annotations(spark):
    text = ["x = 1 //!rule!source", "y //!rule!sink!fn", "//!rule!sink", "z //?file?error?fp //$ECB$error", "plain // comment"]
    lines = spark.createDataFrame([("t", i + 1, t) for i, t in enumerate(text)], "path string, line int, text string")
    got = {(r.line, r.family, r.name, r.kind, r.status) for r in annotations.read(lines).collect()}
    assert got == {(1, "taint", "rule", "source", None), (2, "taint", "rule", "sink", "fn"), (4, "typestate", "file", "error", "fp"), (4, "crypto", "ECB", "error", None)}


def test_annotations_are_used_up(spark):
    note = spark.createDataFrame([("t", 1, "r", "sink", None), ("t", 2, "r", "sink", "fn"), ("t", 3, "q", "sink", None)], "path string, line int, name string, kind string, status string")
    result = spark.createDataFrame([("t", 1, "r", "sink"), ("t", 1, "r", "sink"), ("t", 3, "r", "sink"), ("t", 9, "r", "sink")], "path string, line int, name string, kind string")
    got = sorted((r.line, r.verdict) for r in annotations.checked(result, note).collect())
    assert got == [(1, "ok"), (1, "unexpected"), (2, "known miss"), (3, "ignored"), (3, "missed"), (9, "unexpected")]
    assert annotations.failures(annotations.checked(result, note)).count() == 3


def test_crypto_enum_tags(spark):
    rows = [("f", 0, 0, "new", "e", None), ("f", 0, 1, "literal", "t", "ECB"), ("f", 0, 2, "new", "g", None)]
    stmt = spark.createDataFrame(rows, "func string, block_ord int, ord int, kind string, result string, lit_str string")
    assert [tuple(r) for r in crypto.enum_tags(stmt).collect()] == [("f", "e", "ECB")]


def test_query_engine(spark):
    calls = spark.createDataFrame([("s1", "sink(a)"), ("s2", "sink(a)"), ("s3", "make()")], "s string, callee string")
    origin = spark.createDataFrame([("s1", 0, "result", None, "s3"), ("s2", 0, "allocation", "Bad", None), ("s1", 0, "allocation", "Good", None)], "s string, arg int, kind string, type string, from_site string")
    q = query_engine.CallSite(r"sink\(.*\)", 0, [query_engine.CallSiteReturn(query_engine.CallSite(r"make\(\)")), query_engine.TypeDependency("Go+d")])
    assert [(r.s, r.positions) for r in query_engine.ask(q, calls, origin).collect()] == [("s1", ["s1", "s3"])]


def test_unification(spark):
    value = spark.createDataFrame([(i,) for i in range(1, 8)], "n long")
    copy = pairs(spark, [(1, 2)])
    access = spark.createDataFrame([(1, "f", 3), (2, "f", 4), (3, "g", 5), (4, "g", 6), (7, "f", 7)], "obj long, field string, n long")
    got = {r.n: r.root for r in unify.alias_classes(value, copy, access).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}


def test_type_bits(spark):
    alloc = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 40000)], "f long, c long")
    bits = unify.type_bits(alloc).withColumn("g", F.lit(0))
    assert sum(r.n for r in unify.joined_bits(bits, "g").collect()) == 3


def test_probe_round_trip(spark, tmp_path):
    func = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    entry = spark.createDataFrame([("a",)], "name string")
    edge = spark.createDataFrame([("a", "b", 0.5, "3:4"), ("b", "c", None, None)], "src string, dst string, weight double, context string")
    out = str(tmp_path / "graph")
    probe.text(func, entry, edge).coalesce(1).write.option("compression", "gzip").text(out)
    got = probe.read(spark, out)
    names = {r.id: r.name for r in got["method"].collect()}
    assert sorted(names.values()) == ["a", "b", "c"]
    assert {(names[r.src], names[r.dst], r.weight, r.context) for r in got["edge"].collect()} == {("a", "b", 0.5, "3:4"), ("b", "c", 0.0, None)}
    assert [names[r.f] for r in got["entry"].collect()] == ["a"]


def test_taint_specification(spark, tmp_path):
    one = {"name": "r", "description": "d", "advice": "a", "sources": [{"name": "s", "description": "x"}], "sinks": [{"name": "k.*", "description": "y", "regex": True, "args": [1]}]}
    (tmp_path / "s.json").write_text(json.dumps([one], indent=1))
    got = {(r.role, r.method, tuple(r.args or ()), r.regex) for r in specs.taint(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("source", "s", (), False), ("sink", "k.*", (1,), True)}
    del one["advice"]
    (tmp_path / "t.json").write_text(json.dumps([one], indent=1))
    with pytest.raises(specs.SpecError, match="lacks advice"):
        specs.taint(spark, str(tmp_path / "t.json"))


def test_typestate_specification(spark, tmp_path):
    machine = {
        "style": 0, "name": "file", "type": "File", "description": "d", "advice": "a",
        "states": [{"name": "open", "initial": True}, {"name": "bad", "error": True, "message": "m"}],
        "transitions": [{"from": "open", "method": "close.*", "param": "This", "to": "bad", "type": "OnCall"}],
    }
    path = tmp_path / "m.json"
    path.write_text(json.dumps([machine], indent=1))
    got = specs.typestate(spark, str(path))
    assert got["transition"].count() == 1 and got["state"].where("initial").first()["name"] == "open"
    for broken in ({"style": 3}, {"states": [{"name": "open"}]}, {"transitions": [{**machine["transitions"][0], "param": "Other"}]}):
        path.write_text(json.dumps([{**machine, **broken}], indent=1))
        with pytest.raises(specs.SpecError):
            specs.typestate(spark, str(path))


def test_reports(spark):
    edge = spark.createDataFrame([("a", 'b"'), ("a", 'b"')], "src string, dst string")
    assert [r.value for r in reports.dot(edge).collect()] == ["digraph G {", '  "a" -> "b\\"";', "}"]
    results = spark.createDataFrame([("ECB", "bad", ("p", 1, 2)), ("ECB", "bad", ("p", 1, 2)), ("IV", "weak", None)], "name string, message string, pos struct<path:string,line:int,col:int>")
    assert json.loads(reports.crypto_json(results).first().json) == [{"name": "ECB", "message": "bad", "location": "p:1:2"}, {"name": "IV", "message": "weak", "location": "none"}]
    times = spark.createDataFrame([(10.0,), (2000.0,)], "ms double")
    assert reports.query_times(times).first().anomalies == 1


def test_summaries(spark):
    s = summaries.summaries(spark)
    assert s.select("func").distinct().count() == 114
    assert s.where("func = 'NSStringFromClass'").first()[1:] == (0, summaries.RESULT)


def test_changed_modules(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two")], "module string, text string")
    cache = texts.withColumn("crc", F.crc32(F.col("text").cast("binary"))).where("module = 'a'")
    assert [r.module for r in streaming.changed_modules(texts, cache).collect()] == ["b"]


def test_typestate_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "open"), (1, 2, "close"), (2, 1, "read"), (1, 3, "read")], "obj long, ord long, event string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.typestate_stream(stream, MOVES, "closed").writeStream.format("memory").queryName("states").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.obj, r.ord, r.state) for r in spark.table("states").collect()} == {(1, 1, "opened"), (1, 2, "closed"), (2, 1, "error"), (1, 3, "error")}


def test_edge_weights_run_to_the_end(spark):
    n = 5000  # each takes 52 steps: more than 200,000
    entry = spark.range(n).select(F.col("id").alias("f"))
    none = pairs(spark, [])
    got = weights.edge_weights(entry, none, entry.limit(0), none).collect()
    assert len(got) == n and all(r.src == -1 and r.weight == pytest.approx(1 - (7 / 8) ** 52) for r in got)


def test_relaxation_is_that_of_the_largest_difference():
    import pandas as pd

    rng = random.Random(5)
    for _ in range(20):
        edge = sorted({(rng.randrange(-1, 8), rng.randrange(8)) for _ in range(14)})
        lost = set(rng.sample(range(8), 4)) & {b for _, b in edge}
        level = {i: float(i in lost) for i in range(-1, 8)}
        flow, steps = [0.0] * len(edge), 0
        while True:
            force = [level[b] - level[a] for a, b in edge]
            e = max(range(len(edge)), key=lambda i: (force[i], -i))
            if force[e] < 1e-3:
                break
            moved, steps = force[e] / 8, steps + 1
            flow[e] += moved
            a, b = edge[e]
            level[a] += moved
            level[b] -= moved
            level |= {x: steps * 1e-12 for x in (a, b) if x not in lost} | {-1: 0.0}
        got = weights.relaxed(pd.DataFrame(edge, columns=["src", "dst"]), lost)
        assert got.weight.tolist() == pytest.approx(flow)


@pytest.mark.parametrize("seed, n, edges, plain", [(1, 30, 30, 0), (2, 60, 55, 0), (3, 40, 80, 0), (4, 40, 45, 10_000), (5, 12, 0, 0)])
def test_reach_pairs(spark, monkeypatch, seed, n, edges, plain):
    """Chains, cycles, self-loops, nodes without edges; nodes that are starts and targets at once."""
    from ferrule.operators import reach

    monkeypatch.setattr(reach, "PLAIN", plain)
    rng = random.Random(seed)
    edge = [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)] + [(n + i, n + i + 1) for i in range(9)] + [(n + 20, n + 21), (n + 21, n + 20), (n + 21, n + 22)]
    start = [(f"s{i}", rng.randrange(n + 10)) for i in range(8)] + [("on chain", n), ("same", n), ("nowhere", n + 50), ("s0", n + 3)]
    target = [(f"t{i}", rng.randrange(n + 10)) for i in range(8)] + [("end", n + 9), ("middle", n + 4), ("cycle", n + 21), ("beyond", n + 22), ("nowhere", n + 50)]
    after = {}
    for a, b in edge:
        after.setdefault(a, set()).add(b)

    def reached(x):
        seen, todo = {x}, [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    want = {(s, t) for s, a in start for t, b in target if b in reached(a)}
    frame = lambda rows, kind, a, b: spark.createDataFrame(rows, f"{a} {kind}, {b} long")
    got = reach.reach_pairs(frame(start, "string", "start", "n"), frame(target, "string", "target", "n"), frame(edge, "long", "src", "dst"))
    assert {tuple(r) for r in got.collect()} == want


def classes_by_hand(site, alloc, index, cls, order, exits, funcs):
    """Edges of the unified call graph by passing every class along every block and call until nothing changes."""
    at = {s: (f, b) for s, f, _, _, _, b in site}
    has, edges = {}, {(s, t) for s, _, kind, _, t, _ in site if kind == "named" and t in funcs}
    for f, b, c in alloc:
        has.setdefault((f, b), set()).add(c)
    while True:
        before = len(edges), sum(map(len, has.values()))
        for f, a, b in order:
            has.setdefault((f, b), set()).update(has.get((f, a), ()))
        for s, m in edges:
            has.setdefault((m, 0), set()).update(has.get(at[s], ()))
            for f, b in exits:
                if f == m:
                    has.setdefault(at[s], set()).update(has.get((f, b), ()))
        for s, _, kind, i, _, _ in site:
            if kind == "dynamic":
                edges |= {(s, m) for j, m in index if i == j and any((m, c) in cls for c in has.get(at[s], ()))}
        if before == (len(edges), sum(map(len, has.values()))):
            return {(s, at[s][0], m) for s, m in edges}


@pytest.mark.parametrize("seed", [1, 2])
def test_unified_graph_by_hand(spark, seed):
    """Loops, blocks that nothing leads to, functions never left, exits that are not reached, classes of several words, unknown methods."""
    rng = random.Random(seed)
    funcs = range(40)
    blocks = [(f, b) for f in funcs for b in range(rng.randrange(1, 6))]
    size = {f: 1 + max(b for g, b in blocks if g == f) for f in funcs}
    order = sorted({(f, b, rng.randrange(size[f])) for f, b in blocks if rng.random() < 0.8})
    exits = [(f, b) for f, b in blocks if rng.random() < 0.3 and f % 7]
    site = [(s, *blocks[k := rng.randrange(len(blocks))][:1], rng.choice(["named", "dynamic", "dynamic", "value"]), rng.randrange(12), rng.randrange(50), blocks[k][1]) for s in range(90)]
    alloc = sorted({(*rng.choice(blocks), rng.randrange(0, 400, 7)) for _ in range(25)})
    index = sorted({(rng.randrange(12), rng.randrange(45)) for _ in range(40)})
    cls = sorted({(rng.randrange(45), rng.randrange(0, 400, 7)) for _ in range(400)})
    make = spark.createDataFrame
    got = callgraph.ucg(
        make(site, "s long, f long, kind string, i long, target long, block int"), make([(f,) for f in funcs], "f long"), None, make(alloc, "f long, block int, c long"),
        make(index, "i long, m long"), make(cls, "m long, c long"), make(order, "f long, src int, dst int"), exits=make(exits, "f long, block int"),
    )
    want = classes_by_hand(site, alloc, index, set(cls), order, exits, set(funcs))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > len([x for x in site if x[2] == "named" and x[4] in funcs])


def test_unified_graph_of_nothing(spark):
    make = spark.createDataFrame
    got = callgraph.ucg(make([], "s long, f long, kind string, i long, target long, block int"), make([], "f long"), None, make([], "f long, block int, c long"), make([], "i long, m long"), make([], "m long, c long"))
    assert got.count() == 0
