"""Builders, readers of specifications, reports and passes as queries, with their SQL.

The inputs of each query are projected in SQL that Spark and DuckDB both run, so a query's tables are
the common table expressions of its oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations, callgraph, dispatch, lowering, merge, query_engine, reports, typestate
from ..sources import ir_model, ir_text, specs
from ..sources.projection import facts, with_facts
from ..streaming import changed_modules as changed
from .program import Program
from .store import shared_dir, stored
from .text_queries import module_texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *names: str, inputs: str = ""):
    """Register a query under its function's name; its SQL may use the named facts and its inputs."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            facts(spark, sf_dir, *names)
            with_ = f"WITH {with_facts(*names)}{', ' + inputs if inputs else ''} "
            return function(spark, lambda table: spark.sql(f"{with_}SELECT * FROM {table}"))

        QUERIES[function.__name__] = run
        ORACLES[function.__name__] = f"WITH {with_facts(*names)}{', ' + inputs if inputs else ''}{', ' if sql.lstrip().startswith('x') else ' '}{sql}"
        return function

    return add


# --- builders ------------------------------------------------------------------------------------

DISPATCH_TABLES = """witness AS (SELECT DISTINCT concat('c', c) AS class, concat('p', c % 7) AS protocol FROM dispatch),
base AS (SELECT DISTINCT concat('p', n_nationkey) AS class, concat('q', n_regionkey) AS protocol FROM nation),
witness_entry AS (SELECT concat('c', c) AS class, concat('p', c % 7) AS protocol, concat('i', i) AS idx, CASE WHEN m % 11 <> 0 THEN concat('m', m) END AS method FROM dispatch
  UNION ALL SELECT concat('p', c % 7), concat('p', c % 7), concat('i', i), concat('m', m) FROM dispatch),
vtable_entry AS (SELECT concat('c', c) AS class, concat('v', i) AS idx, CASE WHEN m % 13 <> 0 THEN concat('m', m) END AS method, CASE WHEN i % 4 <> 0 THEN concat('c', c % 5) END AS declaring FROM dispatch),
known AS (SELECT concat('m', f) AS func FROM func WHERE f % 3 <> 0)"""


@query(
    """x AS (SELECT * FROM witness_entry WHERE class <> protocol AND method IN (SELECT func FROM known)),
xv AS (SELECT * FROM vtable_entry WHERE method IS NOT NULL),
xe AS (SELECT class AS a, protocol AS b FROM witness WHERE class <> protocol UNION SELECT class, protocol FROM base UNION SELECT idx, method FROM x UNION SELECT method, class FROM x
  UNION SELECT class, declaring FROM xv WHERE declaring <> class UNION SELECT method, class FROM xv UNION SELECT idx, method FROM xv),
xn AS (SELECT class AS name, 'class' AS kind FROM witness UNION SELECT class, 'class' FROM vtable_entry UNION SELECT protocol, 'protocol' FROM witness UNION SELECT protocol, 'protocol' FROM base
  UNION SELECT idx, 'index' FROM x UNION SELECT idx, 'index' FROM xv UNION SELECT method, 'method' FROM x UNION SELECT method, 'method' FROM xv)
SELECT 'edge' AS what, a, b FROM xe UNION ALL SELECT 'node', name, kind FROM xn""",
    "dispatch",
    "func",
    "ddg_edge",
    inputs=DISPATCH_TABLES,
)
def ddg_build(spark, of):
    nodes, edges = dispatch.build(*(of(t) for t in ("witness", "witness_entry", "base", "vtable_entry", "known")))
    return edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        nodes.select(F.lit("node").alias("what"), F.col("name").alias("a"), F.col("kind").alias("b"))
    )


VALUES = """stmt AS (SELECT CAST(s AS STRING) AS stmt_id, concat('f', f) AS func, CASE s % 7 WHEN 0 THEN 'assign' WHEN 1 THEN 'field_read' WHEN 2 THEN 'field_write' WHEN 3 THEN 'new'
    WHEN 4 THEN 'function_ref' WHEN 5 THEN 'dynamic_ref' ELSE 'apply' END AS kind, CASE WHEN s % 7 <> 2 THEN concat('r', s % 5) END AS result, concat('x', s % 3) AS src, 'o' AS obj,
    concat('d', i % 6) AS field, concat('T', i) AS alloc_type, concat('f', target) AS fn_name, concat('i', i) AS fn_index, s, f, target FROM site),
arg AS (SELECT stmt_id, func, 0 AS idx, concat('x', s % 3) AS sym FROM stmt WHERE kind = 'apply' UNION ALL SELECT stmt_id, func, 1, concat('r', (s + 1) % 5) FROM stmt WHERE kind = 'apply'),
ret AS (SELECT concat('f', f) AS func, concat('r', f % 5) AS sym FROM func),
param AS (SELECT concat('f', f) AS func, 0 AS idx, 'p0' AS sym FROM func UNION ALL SELECT concat('f', f), 1, 'p1' FROM func),
calls AS (SELECT stmt_id AS s, func AS src, CASE WHEN target % 9 = 0 THEN '#UIView.init!initializer.foreign' ELSE concat('f', target) END AS dst FROM stmt WHERE kind = 'apply')"""


@query(
    """x AS (SELECT stmt_id, func AS caller, result AS res, dst FROM stmt JOIN calls ON calls.s = stmt_id WHERE kind = 'apply')
SELECT func || '.' || src AS src, func || '.' || result AS dst FROM stmt WHERE kind = 'assign'
UNION SELECT 'field ' || field, func || '.' || result FROM stmt WHERE kind = 'field_read' UNION SELECT func || '.' || src, 'field ' || field FROM stmt WHERE kind = 'field_write'
UNION SELECT dst || '.' || sym, caller || '.' || res FROM x JOIN ret ON ret.func = dst
UNION SELECT caller || '.' || arg.sym, dst || '.' || param.sym FROM x JOIN arg ON arg.stmt_id = x.stmt_id JOIN param ON param.func = dst AND param.idx = arg.idx
UNION SELECT caller || '.' || arg.sym, caller || '.' || res FROM x JOIN arg ON arg.stmt_id = x.stmt_id AND arg.idx = 1 WHERE dst = '#UIView.init!initializer.foreign'""",
    "site",
    "func",
    inputs=VALUES,
)
def value_edges(spark, of):
    return callgraph.value_edges(*(of(t) for t in ("stmt", "arg", "ret", "param", "calls")))


@query(
    """SELECT DISTINCT func || '.' || result AS node, CASE kind WHEN 'new' THEN alloc_type WHEN 'function_ref' THEN fn_name ELSE fn_index END AS what,
CASE kind WHEN 'new' THEN 'class' WHEN 'function_ref' THEN 'func' ELSE 'index' END AS kind FROM stmt WHERE kind IN ('new', 'function_ref', 'dynamic_ref')""",
    "site",
    "func",
    inputs=VALUES,
)
def value_seeds(spark, of):
    return callgraph.value_seeds(of("stmt"))


@query(
    """x AS (SELECT func, kind, result AS sym FROM stmt WHERE kind IN ('new', 'function_ref', 'dynamic_ref')),
xk AS (SELECT func, sym FROM arg UNION SELECT func, src FROM stmt WHERE kind = 'field_write'
  UNION SELECT func, result FROM stmt WHERE result IS NOT NULL GROUP BY func, result HAVING count(*) > 1)
SELECT kind, count(*) AS n FROM (SELECT DISTINCT x.* FROM x JOIN xk ON xk.func = x.func AND xk.sym = x.sym) GROUP BY kind""",
    "site",
    "func",
    inputs=VALUES,
)
def nontrivial_values(spark, of):
    return callgraph.nontrivial_flow(of("stmt"), of("arg").drop("func"))


NAMED = """named AS (SELECT f, is_library, CASE size % 6 WHEN 0 THEN concat(name, '.deinit') WHEN 1 THEN concat(name, '.modify') WHEN 2 THEN concat('closure ', name)
  WHEN 3 THEN concat('reabstraction thunk ', name) WHEN 4 THEN concat(name, '.__deallocating_deinit') ELSE name END AS name FROM func)"""


@query(
    """x AS (SELECT false AS closures, false AS libraries UNION ALL SELECT false, true UNION ALL SELECT true, false UNION ALL SELECT true, true)
SELECT f, closures, libraries FROM named, x WHERE NOT (name LIKE '%.deinit' OR name LIKE '%.modify' OR name LIKE '%.__deallocating_deinit') AND (libraries OR NOT is_library)
AND (closures OR NOT (name LIKE 'closure %' OR name LIKE 'reabstraction thunk%'))""",
    "func",
    inputs=NAMED,
)
def entry_functions(spark, of):
    func, out = stored(of("named")), None
    for closures in (False, True):
        for libraries in (False, True):
            some = callgraph.entries(func, closures, libraries).select("f", F.lit(closures).alias("closures"), F.lit(libraries).alias("libraries"))
            out = some if out is None else out.unionByName(some)
    return out


# --- passes ----------------------------------------------------------------------------------------


@query(
    """SELECT s, CASE WHEN target % 4 < 3 THEN 'function_ref' ELSE 'builtin_ref' END AS kind,
['location.setActivityType', 'location.setDistanceFilter', 'location.setDesiredAccuracy', 'other'][1 + target % 4] AS fn_name FROM site""",
    "site",
    inputs="refs AS (SELECT s, 'builtin_ref' AS kind, CASE target % 4 WHEN 0 THEN '#CLLocationManager.activityType!setter.foreign' WHEN 1 THEN '#CLLocationManager.distanceFilter!setter.foreign'"
    " WHEN 2 THEN '#CLLocationManager.desiredAccuracy!setter.foreign' ELSE 'other' END AS fn_name FROM site)",
)
def library_setters(spark, of):
    return lowering.library_setters(of("refs"))


@query(
    """SELECT s AS stmt_id, CAST(0 AS INTEGER) AS idx, 'o' AS sym, CAST(NULL AS VARCHAR) AS field FROM site WHERE target % 4 < 3
UNION ALL SELECT s, 1, 'v', ['type', '_value'][1 + target % 4] FROM site WHERE target % 4 < 3
UNION ALL SELECT s, 0, 'v', NULL FROM site WHERE target % 4 = 3 UNION ALL SELECT s, 1, 'o', NULL FROM site WHERE target % 4 = 3""",
    "site",
    inputs="""names AS (SELECT *, CASE target % 4 WHEN 0 THEN '#CLLocationManager.activityType!setter.foreign' WHEN 1 THEN '#CLLocationManager.distanceFilter!setter.foreign'
  WHEN 2 THEN '#CLLocationManager.desiredAccuracy!setter.foreign' ELSE 'other' END AS name FROM site),
calls AS (SELECT concat('a', s) AS stmt_id, CAST(f AS STRING) AS func, block AS block_ord, 2 * s + 1 AS ord, 'apply' AS kind, concat('r', s) AS result, concat('c', s) AS callee_sym,
  CAST(NULL AS STRING) AS fn_name, CAST(NULL AS STRING) AS obj, CAST(NULL AS STRING) AS field, split('v,o', ',') AS args FROM names
  UNION ALL SELECT concat('b', s), CAST(f AS STRING), block, 2 * s, 'builtin_ref', concat('c', s), NULL, name, NULL, NULL, NULL FROM names)""",
)
def setter_arguments(spark, of):
    """What calls take once setters take their receiver first, and the field that was read for it."""
    stmt = of("calls")
    arg = stmt.where("kind = 'apply'").select("stmt_id", "func", F.posexplode("args").alias("idx", "sym"))
    stmt, arg = lowering.setter_calls(stmt, arg)
    read = stmt.where("kind = 'field_read'").select("func", F.col("result").alias("sym"), "obj", "field")
    out = arg.join(read, ["func", "sym"], "left")
    return out.select(F.expr("cast(substring(stmt_id, 2) as bigint)").alias("stmt_id"), "idx", F.coalesce("obj", "sym").alias("sym"), "field")


@query(
    "SELECT DISTINCT w.stmt_id, r.obj, r.field FROM reads r JOIN writes w ON w.func = r.func AND w.pointer = r.alias WHERE NOT (w.block_ord = r.block_ord AND w.ord = r.ord + 1)",
    "site",
    inputs="reads AS (SELECT DISTINCT f AS func, block AS block_ord, i % 20 AS ord, concat('a', i % 7) AS alias, concat('o', i % 3) AS obj, concat('d', i % 4) AS field FROM site WHERE kind < 3),"
    " writes AS (SELECT s AS stmt_id, f AS func, block AS block_ord, i % 20 + 1 AS ord, concat('a', i % 7) AS pointer FROM site WHERE kind >= 3)",
)
def field_alias_writes(spark, of):
    return lowering.field_alias_writes(of("reads"), of("writes")).distinct()


LOWERED = {"new": "3", "field_read": "size % 3", "field_write": "1", "assign": "4", "br_if": "1", "br": "3", "return": "1"}


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT f, '{kind}' AS kind, CAST({n} AS BIGINT) AS n FROM func" for kind, n in LOWERED.items()) + ") WHERE n > 0",
    "func",
)
def ir_lowering(spark, of):
    """Pointer accesses, operators, conditional branches and block arguments of raw functions, by the statements they become."""
    reads = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.when(i < F.col("size") % 3, F.format_string("  a%s = pointer_read p, $`Any`\n", i)).otherwise(""))
    body = [
        F.format_string("func @`f%s` : $`Any` {\nbb0:\n  p = new $`T`\n", "f"),
        F.array_join(reads, ""),
        F.lit("  pointer_write p to p\n  b = binary_op p [arb] p, $`Any`\n  c = binary_op p [reg] p, $`Any`\n  u = unary_op [arb] p, $`Any`\n  cond_br p, true bb1, false bb2\n"),
        F.lit("bb1:\n  br bb3(p)\nbb2:\n  br bb3(u)\nbb3(x : $`Any`):\n  return x\n}\n"),
    ]
    texts = module_texts(of("func").select("module", "f", F.concat(*body).alias("text")), "ir_stage raw\n\n")
    stmts = ir_model.facts_of(stored(ir_text.functions(texts)))["stmt"]
    return stmts.groupBy(F.expr("cast(substring(func, 2) as bigint)").alias("f"), "kind").agg(F.count(F.lit(1)).alias("n"))


ATTRIBUTES = ("none stub", "stub none", "stub model", "none model", "none none", "stub stub")


def merged_modules(spark, of, modules):
    """Which of two modules' bodies a program keeps of each function; modules: names and kinds, in the order of ATTRIBUTES."""
    func, out = of("func"), None
    for i, (module, kind) in enumerate(modules):
        attribute = F.element_at(F.array(*[F.lit(x.split()[i]) for x in ATTRIBUTES]), (F.col("f") % 6 + 1).cast("int"))
        head = F.when(attribute == "none", "func").otherwise(F.concat(F.lit("func ["), attribute, F.lit("]")))
        text = F.concat(head, F.format_string(" @`f%s` : $`Any` {\nbb0:\n", "f"), F.lit(f"  v = new $`Body{i + 1}`\n  return v\n}}\n"))
        # parts of a module for each brand, as a module may be any number of files
        one = module_texts(func.select("module", "f", text.alias("text")), "ir_stage raw\n\n")
        one = ir_text.functions(one.select(F.lit(module).alias("module"), "text")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    rows = stored(out.withColumn("at", F.monotonically_increasing_id()))
    kept = ir_model.facts_of(merge.program(rows))["stmt"].where("kind = 'new'")
    return kept.select(F.expr("cast(substring(func, 2) as bigint)").alias("f"), F.expr("cast(right(alloc_type, 1) as int)").alias("kept"))


MERGED = "SELECT f, CASE WHEN f % 6 IN (1, 2, 3) THEN 2 ELSE 1 END AS kept FROM func"


@query(MERGED, "func")
def merged_program(spark, of):
    """Modules of one kind are merged by name."""
    return merged_modules(spark, of, (("a.ir", 0), ("b.ir", 0)))


@query(MERGED, "func")
def merged_models(spark, of):
    """Written modules are merged after compiled ones, whatever their names."""
    return merged_modules(spark, of, (("z.sil", 0), ("a.ir", 1)))


@query(MERGED, "func")
def merged_library(spark, of):
    """The library's models are merged last, whatever their kind and name."""
    return merged_modules(spark, of, (("z.ir", 1), ("models.ir", 0)))


@query("SELECT concat('m', f) AS module FROM func WHERE f % 3 = 0 OR f % 5 = 0", "func")
def changed_modules(spark, of):
    """Modules whose text is not what the cache holds, or that it lacks."""
    func = of("func")
    module, text = F.concat(F.lit("m"), "f").alias("module"), F.concat("name", F.col("size").cast("string"))
    cache = func.where("f % 5 <> 0").select(module, F.crc32(F.when(F.col("f") % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text).cast("binary")).alias("crc"))
    return changed(func.select(module, text.alias("text")), cache).select("module")


@query(
    """x AS (SELECT f, ['other', 'automotiveNavigation', 'fitness', 'otherNavigation', 'airborne'][1 + f % 5] AS a FROM func WHERE f % 3 > 0)
SELECT f, concat('#CLActivityType.', a, '!enumelt (active)') AS state, CAST(CASE WHEN f % 3 = 1 THEN 2 ELSE 3 END AS INTEGER) AS line FROM x WHERE a <> 'airborne'
UNION ALL SELECT f, '#CLActivityType.other!enumelt (active)', 3 FROM func WHERE f % 3 = 0""",
    "func",
)
def coded_machine(spark, of):
    """A machine written in code, on a program: managers whose activity is set before or after they start, or never, in a function of its own."""
    activity = F.element_at(F.array(*[F.lit(a) for a in typestate.ACTIVITIES]), (F.col("f") % 5 + 1).cast("int"))
    head = F.format_string(
        "func @`f%s` : $`Any` {\nbb0:\n  m = new $`CLLocationManager`\n  t = literal [string] \"#CLActivityType.%s!enumelt\", $`Any`\n  e = new $`CLActivityType`\n  field_write t to e, type\n"
        "  set = builtin_ref @`#CLLocationManager.activityType!setter.foreign`, $`Any`\n  go = builtin_ref @`#CLLocationManager.startMonitoringVisits!foreign`, $`Any`\n",
        F.col("f"), activity,
    )
    set_ = F.format_string('  a = apply set(e, m), $`()` : "%s":2:1\n', F.col("f"))
    go = F.format_string('  b = apply go(m), $`()` : "%s":3:1\n', F.col("f"))
    body = F.when(F.col("f") % 3 == 0, go).when(F.col("f") % 3 == 1, F.concat(go, set_)).otherwise(F.concat(set_, go))
    texts = of("func").select(F.concat(F.lit("m"), "f").alias("module"), F.concat(F.lit("ir_stage raw\n\n"), head, body, F.lit("  return m\n}\n")).alias("text"))
    program = Program(ir_text.functions(texts))
    state = [("VisitsService", 1, n.removesuffix(" (active)"), True, False, False, "", 1) for n, bad in typestate.visits_machine()[1] if bad]
    spec = {
        "machine": spark.createDataFrame([("VisitsService", 1, None, False, "", "")], "name string, style int, type string, class boolean, description string, advice string"),
        "state": spark.createDataFrame(state, "machine string, style int, name string, error boolean, initial boolean, accepting boolean, message string, severity int"),
        "transition": None,
    }
    found = program.typestate(spec, stored(callgraph.trivial(program.sites(), program.func)))
    return found.select(F.col("pos.path").cast("long").alias("f"), "state", F.col("pos.line").alias("line"))


FILE_MOVES = [("open", r"F\d+\.close.*", "closed"), ("closed", r"F\d+\.read.*", "bad")]


@query("SELECT f, CAST(CASE WHEN f % 2 = 0 AND f % 3 = 0 THEN 2 ELSE 4 END AS INTEGER) AS line FROM func WHERE f % 2 = 0 OR f % 5 = 0", "func")
def typestate_outliving(spark, of):
    """Objects that are made, and closed or not, in one function and end in its caller, which may read, close and read them."""
    f = F.col("f").cast("string")
    call = lambda name, line: F.concat(F.lit(f"  r{line} = apply {name}(a), $`()` : \""), f, F.lit(f'":{line}:1\n'))
    refs = F.concat(F.lit("  close = function_ref @`F"), f, F.lit(".close() -> ()`, $`Any`\n  read = function_ref @`F"), f, F.lit(".read() -> ()`, $`Any`\n"))
    made = F.concat(F.lit("func @`made"), f, F.lit("() -> File` : $`File` {\nbb0:\n  a = new $`File`\n"), refs, F.when(F.col("f") % 2 == 0, call("close", 1)).otherwise(""), F.lit("  return a\n}\n"))
    used = F.concat(
        F.lit("func @`use"), f, F.lit("() -> ()` : $`File` {\nbb0:\n  make = function_ref @`made"), f, F.lit("() -> File`, $`Any`\n"), refs, F.lit("  a = apply make(), $`File`\n"),
        F.when(F.col("f") % 3 == 0, call("read", 2)).otherwise(""), F.when(F.col("f") % 5 == 0, call("close", 3)).otherwise(""), call("read", 4), F.lit("  return r4\n}\n"),
    )
    stub = lambda name: F.concat(F.lit("func [stub] @`F"), f, F.lit(f".{name}() -> ()` : $`()` {{\nbb0(self : $`File`):\n  r = new $`()`\n  return r\n}}\n"))
    texts = of("func").select(F.concat(F.lit("m"), f).alias("module"), F.concat(F.lit("ir_stage raw\n\n"), made, used, stub("close"), stub("read")).alias("text"))
    program = Program(ir_text.functions(texts))
    states = [("files", 0, n, n == "bad", n == "open", False, "read when closed" if n == "bad" else None, None) for n in ("open", "closed", "bad")]
    spec = {
        "machine": spark.createDataFrame([("files", 0, "File", False, "", "")], "name string, style int, type string, class boolean, description string, advice string"),
        "state": spark.createDataFrame(states, "machine string, style int, name string, error boolean, initial boolean, accepting boolean, message string, severity int"),
        "transition": spark.createDataFrame([("files", a, m, "This", b, "OnCall") for a, m, b in FILE_MOVES], "machine string, from_state string, method string, param string, to_state string, moment string"),
    }
    found = program.typestate(spec, stored(callgraph.trivial(program.sites(), program.func)))
    return found.select(F.col("pos.path").cast("long").alias("f"), F.col("pos.line").alias("line"))


# --- specifications and reports ----------------------------------------------------------------------


def document(df: DataFrame) -> str:
    """A folder with one JSON file of df's one row and column: a specification, not data."""
    path = f"{shared_dir(df.sparkSession)}/ferrule-spec-{uuid.uuid4().hex}"
    df.coalesce(1).write.text(path)
    return path


ROLES = """roles AS (SELECT DISTINCT ret, module, CASE WHEN size % 10 < 3 THEN 'source' WHEN size % 10 < 6 THEN 'sink' ELSE 'sanitizer' END AS role FROM func)"""


@query(
    """SELECT ret AS name, role, module AS method, CASE WHEN role = 'sink' THEN 1 END AS arg, role = 'source' AS regex, concat('a ', role) AS description, concat('advice on ', ret) AS advice,
concat('about ', ret) AS about FROM roles""",
    "func",
    inputs=ROLES,
)
def spec_taint(spark, of):
    """A taint specification, written as JSON and read back: a rule for each type, a method for each brand."""
    one = F.struct(F.col("module").alias("name"), F.concat(F.lit("a "), "role").alias("description"), F.when(F.col("role") == "sink", F.array(F.lit(1))).alias("args"), (F.col("role") == "source").alias("regex"))
    lists = [F.collect_list(F.when(F.col("role") == r, one)).alias(r + "s") for r in ("source", "sink", "sanitizer")]
    rules = of("roles").groupBy(F.col("ret").alias("name")).agg(*lists)
    rules = rules.select("name", F.concat(F.lit("about "), "name").alias("description"), F.concat(F.lit("advice on "), "name").alias("advice"), "sources", "sinks", "sanitizers")
    read = specs.taint(spark, document(rules.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))))
    return read.select("name", "role", "method", F.try_element_at("args", F.lit(1)).alias("arg"), "regex", "description", "advice", "about")


@query(
    """SELECT ret AS machine, 'NEW' AS from_state, concat(module, '.open') AS method, 'Param1' AS param, 'OPEN' AS to_state, 'OnCallToReturn' AS moment FROM roles WHERE role = 'source'
UNION ALL SELECT ret, 'OPEN', concat(module, '.use'), 'This', 'ERR', 'OnCall' FROM roles WHERE role = 'sink'""",
    "func",
    inputs=ROLES,
)
def spec_typestate(spark, of):
    """Typestate machines, written as JSON and read back: a machine for each type."""
    step = lambda a, suffix, param, b, moment: F.struct(
        F.lit(a).alias("from"), F.concat("module", F.lit(suffix)).alias("method"), F.lit(param).alias("param"), F.lit(b).alias("to"), F.lit(moment).alias("type")
    )
    move = F.when(F.col("role") == "source", step("NEW", ".open", "Param1", "OPEN", "OnCallToReturn")).when(F.col("role") == "sink", step("OPEN", ".use", "This", "ERR", "OnCall"))
    machines = of("roles").groupBy(F.col("ret").alias("name")).agg(F.collect_list(move).alias("transitions"))
    state = lambda n, e, i: F.struct(F.lit(n).alias("name"), F.lit(e).alias("error"), F.lit(i).alias("initial"), F.lit("used when open" if e else None).alias("message"))
    states = F.array(state("NEW", False, True), state("OPEN", False, False), state("ERR", True, False)).alias("states")
    whole = machines.select(F.lit(0).alias("style"), "name", F.col("name").alias("type"), F.lit("about").alias("description"), F.lit("advice").alias("advice"), states, "transitions")
    return specs.typestate(spark, document(whole.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))))["transition"]


HITS = """hits AS (SELECT DISTINCT CASE WHEN a.f % 2 = 0 THEN 'even' ELSE 'odd' END AS name, a.s AS source, b.s AS sink, a.i AS source_i, b.i AS sink_i, a.f FROM site a JOIN site b ON b.f = a.f AND b.kind = 1 WHERE a.kind = 0)"""


@query(
    """SELECT DISTINCT name, concat('about ', name) AS description, concat('advice on ', name) AS advice, concat('m', source_i) AS source, concat('m', sink_i) AS sink,
concat('src.swift:', f, ':1') AS first, concat('src.swift:', f + 1, ':2') AS last FROM hits""",
    "site",
    inputs=HITS,
)
def taint_report(spark, of):
    """The documents of a taint analysis, read back."""
    hits = stored(of("hits"))
    one = F.struct(F.lit("src.swift").alias("path"), F.col("f").cast("int").alias("line"), F.lit(1).alias("col"))
    two = F.struct(F.lit("src.swift").alias("path"), (F.col("f") + 1).cast("int").alias("line"), F.lit(2).alias("col"))
    paths = hits.select("name", "source", "sink", F.array(one, two).alias("path"))
    rules = spark.createDataFrame([(n, f"about {n}", f"advice on {n}") for n in ("even", "odd")], "name string, about string, advice string")
    sites = hits.select(F.col("source").alias("s"), F.col("source_i").alias("i")).union(hits.select("sink", "sink_i")).distinct()
    sites = sites.select("s", F.concat(F.lit("m"), "i").alias("method"), F.lit("called").alias("description"))
    method = "struct<name:string,description:string>"
    shape = f"name string, description string, advice string, paths array<struct<source:{method},sink:{method},path:array<string>>>"
    read = reports.taint_json(paths, rules, sites).select(F.from_json("json", shape).alias("d")).select("d.name", "d.description", "d.advice", F.explode("d.paths").alias("p"))
    return read.select("name", "description", "advice", F.col("p.source.name").alias("source"), F.col("p.sink.name").alias("sink"), F.col("p.path")[0].alias("first"), F.col("p.path")[1].alias("last")).distinct()


@query(
    "SELECT CASE WHEN kind < 3 THEN 'even' ELSE 'odd' END AS name, concat('s.swift:', f, ':', i) AS pos, concat('bad ', kind) AS message, CAST(kind AS INT) AS severity, concat('E', kind) AS state FROM site",
    "site",
    inputs="bad AS (SELECT * FROM site)",
)
def typestate_report(spark, of):
    """The documents of a typestate analysis, read back."""
    pos = F.struct(F.lit("s.swift").alias("path"), F.col("f").cast("int").alias("line"), F.col("i").cast("int").alias("col"))
    name = F.when(F.col("kind") < 3, "even").otherwise("odd").alias("name")
    bad = of("bad").select(name, pos.alias("pos"), F.concat(F.lit("bad "), "kind").alias("message"), F.col("kind").cast("int").alias("severity"), F.concat(F.lit("E"), "kind").alias("state"))
    machine = spark.createDataFrame([("even", "d", "a"), ("odd", "d", "a"), ("none", "d", "a")], "name string, description string, advice string")
    shape = "name string, errors array<struct<pos:string,message:string,severity:int,state:string>>"
    return reports.typestate_json(bad, machine).select(F.from_json("json", shape).alias("d")).select("d.name", F.explode("d.errors").alias("e")).select("name", "e.*")


@query("SELECT DISTINCT concat('R', kind) AS name, concat('rule ', nargs) AS message, CASE WHEN i % 5 = 0 THEN 'none' ELSE concat('c.swift:', f, ':', i) END AS location FROM site", "site", inputs="bad AS (SELECT * FROM site)")
def crypto_report(spark, of):
    """The document of a crypto analysis, read back; equal results are one."""
    pos = F.struct(F.lit("c.swift").alias("path"), F.col("f").cast("int").alias("line"), F.col("i").cast("int").alias("col"))
    bad = of("bad").select(F.concat(F.lit("R"), "kind").alias("name"), F.concat(F.lit("rule "), "nargs").alias("message"), F.when(F.col("i") % 5 != 0, pos).alias("pos"))
    return reports.crypto_json(bad).select(F.explode(F.from_json("json", "array<struct<name:string,message:string,location:string>>")).alias("r")).select("r.*")


@query("SELECT 'name' AS list, name AS func FROM func UNION ALL SELECT 'missing', name FROM func WHERE is_stub", "func")
def function_lists(spark, of):
    func = of("func").select(F.col("name").alias("func"), F.when(F.col("is_stub"), "stub").alias("attribute"))
    names, missing = reports.function_names(func), reports.missing_models(func)
    return names.select(F.lit("name").alias("list"), "func").unionByName(missing.select(F.lit("missing").alias("list"), "func"))


@query("SELECT count(*) AS queries, sum(ms) AS total_ms, avg(ms) AS average_ms, count_if(ms > 1000) AS anomalies FROM metric", "func", inputs="metric AS (SELECT f * 37 % 2000 AS ms FROM func)")
def query_times(spark, of):
    return reports.query_times(of("metric"))


@query("SELECT 'src.swift' AS path, f AS line, s AS stmt_id FROM site WHERE kind <> 2", "site", inputs="stmt AS (SELECT s AS stmt_id, CASE WHEN kind <> 2 THEN 'src.swift' END AS pos_path, f AS pos_line FROM site)")
def line_map(spark, of):
    return reports.line_map(of("stmt"))


ORIGIN = """calls AS (SELECT s, concat('fn', target) AS callee FROM site),
origin AS (SELECT s, nargs AS arg, 'allocation' AS kind, concat('T', i % 5) AS type, CAST(NULL AS BIGINT) AS from_site FROM site
  UNION ALL SELECT DISTINCT a.s, a.nargs, 'result', NULL, b.s FROM site a JOIN site b ON b.f = a.f AND b.kind < 3 WHERE a.kind >= 3)"""


@query(
    """x AS (SELECT a.s, list_sort(list_distinct(list_append(list(o.from_site), a.s))) AS p FROM calls a JOIN origin o ON o.s = a.s AND o.kind = 'result' JOIN calls b ON b.s = o.from_site
  WHERE regexp_full_match(a.callee, 'fn.*[13579]') AND regexp_full_match(b.callee, 'fn.*[02468]') AND a.s IN (SELECT s FROM origin WHERE kind = 'allocation' AND regexp_full_match(type, 'T[012]')) GROUP BY a.s)
SELECT s, array_to_string(p, ',') AS positions FROM x""",
    "site",
    inputs=ORIGIN,
)
def query_answers(spark, of):
    """Call sites with an allocation of some type and the result of a matching call among what reaches them."""
    tree = query_engine.CallSite("fn.*[13579]", needs=[query_engine.TypeDependency("T[012]", some=True), query_engine.CallSiteReturn(query_engine.CallSite("fn.*[02468]"))])
    return query_engine.ask(tree, of("calls"), of("origin")).select("s", F.array_join("positions", ",").alias("positions"))


@query(
    """x AS (SELECT line, kind, row_number() OVER (PARTITION BY line, kind) AS k FROM res), xn AS (SELECT line, kind, status, row_number() OVER (PARTITION BY line, kind ORDER BY status NULLS FIRST) AS k FROM note),
xj AS (SELECT coalesce(x.line, xn.line) AS line, coalesce(x.kind, xn.kind) AS kind, x.k AS r, xn.k AS n, xn.status FROM x FULL JOIN xn ON x.line = xn.line AND x.kind = xn.kind AND x.k = xn.k),
xv AS (SELECT line, kind, CASE WHEN n IS NULL AND (line NOT IN (SELECT line FROM note) OR (line, kind) IN (SELECT (line, kind) FROM note)) THEN 'unexpected'
  WHEN n IS NULL THEN 'ignored' WHEN r IS NULL AND status = 'fn' THEN 'known miss' WHEN r IS NULL THEN 'missed' WHEN status = 'fn' THEN 'found after all' ELSE 'ok' END AS verdict FROM xj)
SELECT line, kind, verdict FROM xv WHERE verdict IN ('unexpected', 'missed', 'found after all')""",
    "site",
    inputs="res AS (SELECT f AS line, i % 3 AS kind FROM site WHERE kind < 3), note AS (SELECT f AS line, i % 3 AS kind, CASE nargs WHEN 0 THEN 'fn' WHEN 1 THEN 'fp' END AS status FROM site WHERE kind >= 3)",
)
def annotation_failures(spark, of):
    rows = [of(t).selectExpr("'main' AS path", "line", "'rule' AS name", "kind", *more) for t, more in (("res", ()), ("note", ("status",)))]
    return annotations.failures(annotations.checked(*rows)).select("line", "kind", "verdict")
