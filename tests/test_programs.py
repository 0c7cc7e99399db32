"""From program text to analysis results."""

import pytest

from ferrule.operators import callgraph, dispatch, flow, lowering, taint
from ferrule.sources import ir_model, ir_text, sil

SIMPLE = """ir_stage raw
func @`main_app` : $`Int32` {
bb0:
  f0 = function_ref @`app.source() -> String`, $`Any`
  x = apply f0(), $`String` : "app/main.x":9:3
  box = new $`*String`
  pointer_write x to box
  y = pointer_read box, $`String`
  f1 = function_ref @`app.sink(it: String) -> ()`, $`Any`
  r = apply f1(y), $`()` : "app/main.x":10:3
  clean = literal [string] "ok", $`String`
  r2 = apply f1(clean), $`()` : "app/main.x":11:3
  return r
}
func @`app.source() -> String` : $`String` {
bb0:
  s = new $`String`
  return s
}
func @`app.sink(it: String) -> ()` : $`()` {
bb0(it : $`String`):
  v = new $`()`
  return v
}
"""

FIELDS = """ir_stage raw
func @`main_app` : $`Int32` {
bb0:
  f0 = function_ref @`src`, $`Any`
  x = apply f0(), $`String` : "m":1:1
  o = new $`Obj`
  field_write x to o, a
  alias = assign o, $`Obj`
  good = field_read alias, b, $`String`
  bad = field_read alias, a, $`String`
  id = function_ref @`id`, $`Any`
  c = literal [string] "c", $`String`
  same = apply id(bad), $`String`
  other = apply id(c), $`String`
  f1 = function_ref @`snk`, $`Any`
  r1 = apply f1(good), $`()` : "m":2:1
  r2 = apply f1(same), $`()` : "m":3:1
  r3 = apply f1(other), $`()` : "m":4:1
  return r1
}
func @`id` : $`String` {
bb0(p : $`String`):
  return p
}
func @`src` : $`String` {
bb0:
  s = new $`String`
  return s
}
func @`snk` : $`()` {
bb0(it : $`String`):
  v = new $`()`
  return v
}
"""


def program(spark, text, module="app"):
    texts = spark.createDataFrame([(module, text)], "module string, text string")
    return ir_model.facts_of(ir_text.functions(texts).cache())


def named_sites(f):
    s = f["stmt"].where("kind = 'apply'").selectExpr("stmt_id as s", "func as f", "callee_sym", "result as r")
    d = f["stmt"].where("kind = 'function_ref'").selectExpr("func as f", "result as callee_sym", "fn_name as target")
    return s.join(d, ["f", "callee_sym"]).selectExpr("s", "f", "'named' as kind", "target", "r")


def tainted(spark, text, sources, sinks):
    f = program(spark, text)
    func = f["function"].selectExpr("func as f", "func as name")
    site = named_sites(f)
    edge = callgraph.trivial(site, func)
    edges = flow.program_edges(f["stmt"])
    args, rets, _ = flow.program_calls(f["stmt"], f["arg"], f["param"], edge)
    use = f["arg"].selectExpr("stmt_id as s", "idx", "sym as v")
    spec = spark.createDataFrame(
        [("rule", "source", s, None, False) for s in sources] + [("rule", "sink", s, None, True) for s in sinks],
        "name string, role string, method string, args array<int>, regex boolean",
    )
    hits = taint.forward(spec, func, site, edge, use, edges, args, rets)
    lines = taint.paths(hits, f["stmt"]).collect()
    return sorted((r.path[0].line, r.path[-1].line) for r in lines)


def test_source_to_sink(spark):
    assert tainted(spark, SIMPLE, ["app.source() -> String"], [r"app\.sink.*"]) == [(9, 10)]


def test_fields_and_calls_are_told_apart(spark):
    assert tainted(spark, FIELDS, ["src"], ["snk"]) == [(1, 3)]


def test_unknown_names_match_nothing(spark):
    assert tainted(spark, SIMPLE, ["no.such"], [".*"]) == []


def test_facts(spark):
    f = program(spark, open("tests/fixtures/straight.ir").read())
    assert {(r.func, r.attribute, r.nargs) for r in f["function"].collect()} == {("main_app", None, 2), ("app.source() -> String", "stub", 0), ("app.sink(it: String) -> ()", None, 1)}
    edges = {(r.src, r.dst) for r in f["block_edge"].where("func = 'main_app'").collect()}
    assert (0, 1) in edges and (0, 2) in edges  # the conditional branch and its fall-through
    tags = [r.assign_tag for r in f["stmt"].where("assign_tag is not null").collect()]
    assert tags.count("bb arg") == 3


def test_printing_reads_back(spark):
    texts = spark.createDataFrame([("app", open("tests/fixtures/straight.ir").read())], "module string, text string")
    raw = ir_text.functions(texts, lowered=False)
    again = ir_text.functions(ir_text.printed(raw), lowered=False)
    key = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert key(raw) == key(again)


@pytest.mark.parametrize(
    "body, error",
    [
        ("bb0:\n  return x\n", ir_model.IncompleteProgram),
        ("bb0:\n  x = new $`A`\n  br bb7\n", ir_model.IncompleteProgram),
        ("bb0:\n  x = frobnicate y, $`A`\n  return x\n", ir_text.ParseError),
        ("bb0:\n  x = new $`A`\n", ir_text.ParseError),
    ],
)
def test_broken_programs(body, error):
    with pytest.raises(error):
        for f in ir_text.parse("ir_stage raw\nfunc @`f` : $`A` {\n" + body + "}\n", "m"):
            ir_model.canonical(f)


SIL = """sil_stage canonical

sil_global hidden @$g : $String

// main
sil [ossa] @main : $@convention(c) (Int32, Ptr) -> Int32 {
bb0(%0 : $Int32, %1 : $Ptr):
  alloc_global @$g, loc "t.x":1:5, scope 2 // id: %2
  %3 = global_addr @$g : $*String, loc "t.x":1:5, scope 2 // user: %6
  %4 = function_ref @$src : $@convention(thin) () -> @owned String, loc "t.x":1:15, scope 2 // user: %5
  %5 = apply %4() : $@convention(thin) () -> @owned String, loc "t.x":1:15, scope 2 // user: %6
  store %5 to [init] %3 : $*String, loc "t.x":1:15, scope 2 // id: %6
  %7 = load_borrow %3 : $*String, loc "t.x":2:12, scope 3
  %8 = class_method %7 : $A, #A.f : (A) -> () -> (), $@convention(method) (@guaranteed A) -> (), loc "t.x":3:1
  %9 = apply %8(%7) : $@convention(method) (@guaranteed A) -> (), loc "t.x":3:1, scope 3
  %10 = integer_literal $Builtin.Int32, -7, scope 3
  %11 = struct $Int32 (%10 : $Builtin.Int32), scope 3
  %12 = builtin "cmp_eq"(%10 : $Builtin.Int32, %10 : $Builtin.Int32) : $Builtin.Int1
  cond_br %12, bb1, bb2(%11 : $Int32)
bb1:
  %14 = enum $Optional<A>, #Optional.some!enumelt, %7 : $A
  switch_enum %14 : $Optional<A>, case #Optional.some!enumelt: bb3, case #Optional.none!enumelt: bb4
bb2(%16 : $Int32):
  return %16 : $Int32, scope 3
bb3(%17 : $A):
  return %11 : $Int32
bb4:
  unreachable
} // end sil function 'main'

sil @$src : $@convention(thin) () -> @owned String

sil_vtable A {
  #A.f: (A) -> () -> () : @$af\t// A.f()
}

sil_vtable B {
  #A.f: (A) -> () -> () : @$bf [override]\t// B.f()
}

sil_witness_table hidden A: P module test {
  base_protocol Q: A: Q module test
  method #P.f: <Self where Self : P> (Self) -> () -> () : @$af\t// witness
}
"""


def test_sil():
    fs = {f.name: f for f in sil.parse(SIL, "t")}
    assert set(fs) == {"main_t", "$src", "cmp_eq", "entry_t"}
    out = ir_model.canonical(fs["main_t"])
    kinds = [s["kind"] for b in out.blocks for s in b.stmts]
    assert "singleton_read" in kinds and "dynamic_ref" in kinds and "br_if" in kinds
    assert not set(kinds) & ir_model.RAW_ONLY
    rows = sil.tables(SIL)
    assert rows["vtable_entry"] == [("A", "#A.f", "$af", "A"), ("B", "#A.f", "$bf", "A")]
    assert rows["witness"] == [("A", "P")] and rows["base"] == [("A", "Q")]
    assert rows["witness_entry"] == [("A", "P", "#P.f", "$af")]


def test_sil_folder_is_parsed_once(spark, tmp_path):
    """Functions and tables of nested folders, each read from what one parse has written; other files are left alone."""
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.sil").write_text(SIL)
    (tmp_path / "deep" / "b.sil").write_text(SIL)
    (tmp_path / "c.txt").write_text("no module")
    functions, tables = sil.read(spark, str(tmp_path))
    assert {r.func for r in functions.where("module = 'b.sil'").collect()} == {f.name for f in sil.parse(SIL, "b.sil")}
    for name, rows in sil.tables(SIL).items():
        assert sorted(tuple(r) for r in tables[name].collect()) == sorted((m, *row) for m in ("a.sil", "b.sil") for row in rows)
        assert "Python" not in tables[name]._jdf.queryExecution().toString() and "Pandas" not in tables[name]._jdf.queryExecution().toString()
    assert sil.texts(spark, str(tmp_path), "*.none").inputFiles() == []


def test_sil_unsupported():
    text = "sil_stage canonical\nsil @f : $() -> () {\nbb0:\n  %0 = move_value %1 : $A\n}\n"
    with pytest.raises(ir_model.UnsupportedInstruction):
        sil.parse(text, "t")


@pytest.mark.parametrize("bits, value", [("0x3FF0000000000000", 1.0), ("0x7FEFFFFFFFFFFFFF", 1.7976931348623157e308), ("0xBFF0000000000000", 0.0), ("zz", 0.0)])
def test_hex_floats(bits, value):
    assert sil.hex_float(bits) == value


def test_dispatch_graph(spark):
    rows = sil.tables(SIL)
    df = {n: spark.createDataFrame(rows[n], sil.TABLES[n]) for n in ("vtable_entry", "witness", "witness_entry", "base")}
    known = spark.createDataFrame([("$af",), ("$bf",)], "func string")
    nodes, edges = dispatch.build(df["witness"], df["witness_entry"], df["base"], df["vtable_entry"], known)
    index_method, method_class = dispatch.from_graph(nodes, edges)
    assert {tuple(r) for r in dispatch.targets(index_method, method_class).collect()} == {("#A.f", "$af"), ("#A.f", "$bf"), ("#P.f", "$af")}
    only_b = spark.createDataFrame([("B",)], "c string")
    assert {tuple(r) for r in dispatch.targets(index_method, method_class, only_b).collect()} == {("#A.f", "$bf")}


def test_promotion(spark):
    f = program(spark, SIMPLE)
    out = lowering.promoted(f["stmt"], f["arg"]).where("func = 'main_app' and assign_tag is not null").collect()
    assert sorted(r.assign_tag for r in out) == ["pointer read", "pointer write"]
    assert all(r.kind == "assign" for r in out)


def test_dull_and_closure_functions(spark):
    func = spark.createDataFrame([(1, "a.deinit", False), (2, "closure #1 in f", False), (3, "f", False), (4, "lib", True)], "f int, name string, is_library boolean")
    assert [r.f for r in callgraph.entries(func).collect()] == [3]
    assert sorted(r.f for r in callgraph.entries(func, closures=True, libraries=True).collect()) == [2, 3, 4]


SPEC = """[{"name": "rule", "description": "d", "advice": "a",
 "sources": [{"name": "src", "description": "makes"}], "sinks": [{"name": "snk", "description": "takes"}]}]"""


@pytest.mark.parametrize("algorithm", ["chafp", "vtafp", "ucg", "ucg_no_vta", "prta", "orta"])
def test_command_line(spark, tmp_path, algorithm):
    import json

    from ferrule import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.ir").write_text(FIELDS)
    (tmp_path / "spec.json").write_text(SPEC)
    args = [str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--cg-algo", algorithm, "-t", str(tmp_path / "spec.json"), "-d", "-n", "--probe"]
    out = cli.run(spark, cli.Options(**vars(cli.parser().parse_args(args))))
    assert {(r.src, r.dst) for r in out["call_edge"].collect()} == {("main_app", x) for x in ("src", "id", "snk")}
    found = json.loads(out["taint"].first().json)
    assert [p["path"] for p in found["paths"]] == [["m:1:1", "m:3:1"]]
    assert json.loads(out["stats"].first().json)["resolved"] == 6


MACHINE = """[{"style": 0, "name": "file", "type": "File", "description": "d", "advice": "a",
 "states": [{"name": "open", "initial": true}, {"name": "closed"}, {"name": "bad", "error": true, "message": "read after close", "severity": 2}],
 "transitions": [{"from": "open", "method": "File\\\\.close.*", "param": "This", "to": "closed", "type": "OnCall"},
                 {"from": "closed", "method": "File\\\\.read.*", "param": "This", "to": "bad", "type": "OnCall"}]}]"""

FILES = """ir_stage raw
func @`main_app` : $`Int32` {
bb0:
  a = new $`File` : "m":1:1
  b = new $`File` : "m":2:1
  done = function_ref @`finish(it: File) -> ()`, $`Any`
  read = function_ref @`File.read() -> ()`, $`Any`
  x = apply done(a), $`()` : "m":3:1
  y = apply read(a), $`()` : "m":4:1
  z = apply read(b), $`()` : "m":5:1
  return x
}
func @`finish(it: File) -> ()` : $`()` {
bb0(it : $`File`):
  close = function_ref @`File.close() -> ()`, $`Any`
  r = apply close(it), $`()` : "m":9:1
  return r
}
func [stub] @`File.close() -> ()` : $`()` {
bb0(self : $`File`):
  r = new $`()`
  return r
}
func [stub] @`File.read() -> ()` : $`()` {
bb0(self : $`File`):
  r = new $`()`
  return r
}
"""

KEYS = """ir_stage raw
func @`main_app` : $`Int32` {
bb0:
  text = literal [string] "0123", $`Builtin.RawPointer`
  key = new $`String`
  field_write text to key, _value
  init = function_ref @`CryptoSwift.HMAC.__allocating_init(key: Swift.String) throws -> CryptoSwift.HMAC`, $`Any`
  h = apply init(key), $`HMAC` : "m":5:1
  given = function_ref @`app.random() -> String`, $`Any`
  other = apply given(), $`String`
  h2 = apply init(other), $`HMAC` : "m":7:1
  return h
}
func [stub] @`app.random() -> String` : $`String` {
bb0:
  r = new $`String`
  return r
}
func [stub] @`CryptoSwift.HMAC.__allocating_init(key: Swift.String) throws -> CryptoSwift.HMAC` : $`HMAC` {
bb0(k : $`String`):
  r = new $`HMAC`
  return r
}
"""


def run_program(spark, tmp_path, text, *more):
    from ferrule import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.ir").write_text(text)
    args = [str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--cg-algo", "prta", *more]
    return cli.run(spark, cli.Options(**vars(cli.parser().parse_args(args))))


def test_typestate_of_a_program(spark, tmp_path):
    import json

    (tmp_path / "m.json").write_text(MACHINE)
    out = run_program(spark, tmp_path, FILES, "-e", str(tmp_path / "m.json"))
    found = json.loads(out["typestate"].first().json)
    assert [(e["pos"], e["state"], e["severity"]) for e in found["errors"]] == [("m:4:1", "bad", 2)]


OUTLIVING = """ir_stage raw
func @`main_app` : $`Int32` {
bb0:
  make = function_ref @`made() -> File`, $`Any`
  keep = function_ref @`kept(in: Box) -> ()`, $`Any`
  read = function_ref @`File.read() -> ()`, $`Any`
  outside = function_ref @`elsewhere.seal(file: File) -> ()`, $`Any`
  a = apply make(), $`File` : "m":1:1
  x = apply read(a), $`()` : "m":2:1
  box = new $`Box`
  k = apply keep(box), $`()` : "m":3:1
  b = field_read box, file, $`File`
  y = apply read(b), $`()` : "m":4:1
  c = new $`File`
  o = apply outside(c), $`()` : "m":5:1
  z = apply read(c), $`()` : "m":6:1
  d = new $`File`
  br bb1
bb1:
  w = apply read(d), $`()` : "m":7:1
  more = new $`Bool`
  br_if more, bb1
bb2:
  return x
}
func @`made() -> File` : $`File` {
bb0:
  f = new $`File`
  close = function_ref @`File.close() -> ()`, $`Any`
  r = apply close(f), $`()` : "m":11:1
  return f
}
func @`kept(in: Box) -> ()` : $`()` {
bb0(in : $`Box`):
  f = new $`File`
  close = function_ref @`File.close() -> ()`, $`Any`
  r = apply close(f), $`()` : "m":21:1
  field_write f to in, file
  return r
}
""" + FILES[FILES.index("func [stub]"):]


def test_objects_that_outlive_the_function_that_made_them(spark, tmp_path):
    """Returned or stored in an argument's field, an object ends in the caller; a loop without transitions ends, too.

    Calls that lead into the program take transitions OnCall, others those OnCallToReturn."""
    import json

    (base,) = json.loads(MACHINE)
    machines = []
    for moment in ("OnCall", "OnCallToReturn", "None"):
        close, read = base["transitions"]
        machines.append({**base, "name": moment, "transitions": [{**close, "method": "(File\\.close|elsewhere).*", "type": moment}, read]})
    (tmp_path / "m.json").write_text(json.dumps(machines))
    out = run_program(spark, tmp_path, OUTLIVING, "-e", str(tmp_path / "m.json"))
    found = [json.loads(r.json) for r in out["typestate"].collect()]
    got = {d["name"]: sorted(e["pos"] for e in d["errors"] or []) for d in found}
    # 2 and 4: closed where they were made; 6: closed outside the program
    assert {n: got.get(n, []) for n in ("OnCall", "OnCallToReturn", "None")} == {"OnCall": ["m:2:1", "m:4:1"], "OnCallToReturn": ["m:6:1"], "None": []}


def test_crypto_of_a_program(spark, tmp_path):
    import json

    out = run_program(spark, tmp_path, KEYS, "--crypto")
    assert [(r["name"], r["location"]) for r in json.loads(out["crypto"].first().json)] == [("KEY", "m:5:1")]


WAYS = """ir_stage raw
func @`main_app` : $`Int32` {
bb0:
  f0 = function_ref @`src`, $`Any`
  x = apply f0(), $`String` : "m":1:1
  o = new $`Obj` : "m":2:1
  field_write x to o, a : "m":3:1
  w = function_ref @`wrap`, $`Any`
  y = apply w(o), $`String` : "m":4:1
  f1 = function_ref @`snk`, $`Any`
  r1 = apply f1(y), $`()` : "m":4:9
  c = function_ref @`outer`, $`Any`
  z = apply c(x), $`String` : "m":6:1
  r2 = apply f1(z), $`()` : "m":7:1
  return r1
}
func @`wrap` : $`String` {
bb0(p : $`Obj`):
  q = field_read p, a, $`String` : "m":20:1
  return q
}
func @`outer` : $`String` {
bb0(p : $`String`):
  c = function_ref @`clean`, $`Any`
  q = apply c(p), $`String` : "m":30:1
  return q
}
func @`clean` : $`String` {
bb0(p : $`String`):
  return p
}
func @`src` : $`String` {
bb0:
  s = new $`String`
  return s
}
func @`snk` : $`()` {
bb0(it : $`String`):
  v = new $`()`
  return v
}
"""


def test_paths_of_a_program(spark, tmp_path):
    """Every statement of the way, the second of two on one line left out; the flow through a sanitizer, two calls down, is not reported."""
    import json

    spec = SPEC.replace('"sinks"', '"sanitizers": [{"name": "clean", "description": "cleans"}], "sinks"')
    (tmp_path / "spec.json").write_text(spec)
    out = run_program(spark, tmp_path, WAYS, "-t", str(tmp_path / "spec.json"), "-p")
    found = json.loads(out["taint"].first().json)
    assert [p["path"] for p in found["paths"]] == [["m:1:1", "m:3:1", "m:4:1"]]


def test_plain_taint_sees_both_flows(spark, tmp_path):
    import json

    spec = SPEC.replace('"sinks"', '"sanitizers": [{"name": "clean", "description": "cleans"}], "sinks"')
    (tmp_path / "spec.json").write_text(spec)
    out = run_program(spark, tmp_path, WAYS, "-t", str(tmp_path / "spec.json"))
    assert [p["path"] for p in json.loads(out["taint"].first().json)["paths"]] == [["m:1:1", "m:4:9"], ["m:1:1", "m:7:1"]]


LOCATION = """ir_stage raw
func @`main_app` : $`Any` {
bb0:
  set_accuracy = builtin_ref @`#CLLocationManager.desiredAccuracy!setter.foreign`, $`Any`
  set_filter = builtin_ref @`#CLLocationManager.distanceFilter!setter.foreign`, $`Any`
  start = builtin_ref @`#CLLocationManager.startUpdatingLocation!foreign`, $`Any`
  hundred = singleton_read kCLLocationAccuracyHundredMeters from Globals_app, $`Double`
  number = literal [float] 4000.5, $`Builtin.FPIEEE64`
  metres = new $`Double`
  field_write number to metres, _value
  bad = new $`CLLocationManager`
  a = apply start(bad), $`()` : "m":2:1
  b = apply set_accuracy(hundred, bad), $`()` : "m":3:1
  c = apply set_filter(metres, bad), $`()` : "m":4:1
  good = new $`CLLocationManager`
  d = apply start(good), $`()` : "m":5:1
  e = apply set_accuracy(hundred, good), $`()` : "m":6:1
  unstarted = new $`CLLocationManager`
  f = apply set_filter(metres, unstarted), $`()` : "m":7:1
  return a
}
"""


def test_a_machine_in_code_on_a_program(spark):
    """Accuracy is a global, the filter a number held in a field; an error only for what is started, with a filter that doesn't fit."""
    from ferrule.operators import typestate
    from ferrule.plans.program import Program

    texts = spark.createDataFrame([("app", LOCATION)], "module string, text string")
    p = Program(ir_text.functions(texts))
    states = [("StandardLocationService", 1, n.removesuffix(" (active)"), True, False, False, f"not {n}", 2) for n, bad in typestate.standard_machine()[1] if bad]
    spec = {
        "machine": spark.createDataFrame([("StandardLocationService", 1, None, False, "", "")], "name string, style int, type string, class boolean, description string, advice string"),
        "state": spark.createDataFrame(states, "machine string, style int, name string, error boolean, initial boolean, accepting boolean, message string, severity int"),
    }
    found = p.typestate(spec, p.call_graph("prta")).collect()
    assert [(r.pos.line, r.state, r.severity) for r in found] == [(4, "Hundred_4096 (active)", 2)]


CIPHER = """ir_stage raw
func @`main_app` : $`Any` {
bb0:
  make = function_ref @`Swift._allocateUninitializedArray<A>(Builtin.Word) -> ([A], Builtin.RawPointer)`, $`Any`
  n = literal [int] 16, $`Builtin.Word`
  pair = apply make(n), $`Pair`
  mode = new $`BlockMode`
  tag = literal [string] "#BlockMode.ECB!enumelt", $`Builtin.RawPointer`
  field_write tag to mode, type
  init = function_ref @`CryptoSwift.AES.__allocating_init(key: [Swift.UInt8], blockMode: CryptoSwift.BlockMode) throws -> CryptoSwift.AES`, $`Any`
  c = apply init(pair, mode), $`AES` : "m":5:1
  text = literal [string] "0123", $`Builtin.RawPointer`
  hmac = function_ref @`CryptoSwift.HMAC.__allocating_init(key: Swift.String) throws -> CryptoSwift.HMAC`, $`Any`
  h = apply hmac(text), $`HMAC` : "m":6:1
  return c
}
func [stub] @`Swift._allocateUninitializedArray<A>(Builtin.Word) -> ([A], Builtin.RawPointer)` : $`Pair` {
bb0(n : $`Builtin.Word`):
  r = new $`Pair`
  return r
}
func [stub] @`CryptoSwift.AES.__allocating_init(key: [Swift.UInt8], blockMode: CryptoSwift.BlockMode) throws -> CryptoSwift.AES` : $`AES` {
bb0(k : $`Key`, b : $`BlockMode`):
  r = new $`AES`
  return r
}
func [stub] @`CryptoSwift.HMAC.__allocating_init(key: Swift.String) throws -> CryptoSwift.HMAC` : $`HMAC` {
bb0(k : $`String`):
  r = new $`HMAC`
  return r
}
"""


def test_arrays_and_enumerations_in_crypto_rules(spark, tmp_path):
    import json

    out = run_program(spark, tmp_path, CIPHER, "--crypto")
    found = [(r["name"], r["message"], r["location"]) for r in json.loads(out["crypto"].first().json)]
    assert found == [("ECB", "ECB mode (argument 1)", "m:5:1"), ("KEY", "constant key (argument 0)", "m:5:1"), ("KEY", "constant key: 0123 (argument 0)", "m:6:1")]


def test_written_models_take_the_place_of_stubs(spark):
    """Kinds before names: a model in a module that sorts first still comes after the compiled stub."""
    from ferrule.operators import merge

    body = lambda module, attribute, kind, at: (module, "f", attribute, kind, at)
    rows = [body("a.ir", "model", 1, 0), body("z.sil", "stub", 0, 1)]
    df = spark.createDataFrame(rows, "module string, func string, attribute string, kind int, at long")
    assert [r.module for r in merge.program(df).collect()] == ["a.ir"]
    rows = [body("models.ir", "model", 0, 0), body("z.ir", "stub", 1, 1)]
    df = spark.createDataFrame(rows, df.schema)
    assert [r.module for r in merge.program(df).collect()] == ["models.ir"]
