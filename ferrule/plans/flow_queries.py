"""Value flow, taint, typestate, crypto, merging and checking as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import annotations, crypto, flow, lowering, merge, taint, typestate, unify
from ..sources.projection import facts, with_facts
from .store import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Register a query under its function's name; sql may use the named facts."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            body = sql.lstrip()
            head = f"WITH RECURSIVE {with_facts(*names)}" if names else ""
            ORACLES[function.__name__] = f"{head}{' ' if body.upper().startswith('SELECT') or not names else ', '}{body}"
        return function

    return add


# --- flow -------------------------------------------------------------------------------------

FIELD_FLOW = """op AS (SELECT f, a, b, op, field FROM ffield),
seeds AS (SELECT f FROM func WHERE size = 7),
r(f, v, p) AS (
  SELECT f, 0, []::VARCHAR[] FROM seeds
  UNION
  SELECT r.f, e.b, CASE WHEN e.op = 0 THEN r.p WHEN e.op = 1 THEN r.p[2:] ELSE list_prepend(e.field, r.p) END
  FROM r JOIN op e ON e.f = r.f AND e.a = r.v
  WHERE e.op = 0 OR (e.op = 1 AND len(r.p) > 0 AND r.p[1] = e.field) OR (e.op = 2 AND len(r.p) < 5))
SELECT f AS seed, f, v::VARCHAR AS v, array_to_string(p, '.') AS path FROM r"""


@query(FIELD_FLOW, "ffield", "func")
def field_flow_k(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir, "ffield", "func")
    name = F.element_at(F.array(F.lit("copy"), F.lit("load"), F.lit("store")), F.col("op").cast("int") + 1)
    edges = f["ffield"].withColumn("op", name).withColumn("a", F.col("a").cast("string")).withColumn("b", F.col("b").cast("string"))
    seeds = f["func"].where("size = 7").select(F.col("f").alias("seed"), "f", F.lit("0").alias("v"))
    return flow.within(seeds, edges).select("seed", "f", "v", F.array_join("p", ".").alias("path"))


def flow_inputs(spark, sf_dir):
    f = facts(spark, sf_dir, "fedge", "farg", "fcall", "fspec", "func")
    f["edges"] = f["fedge"].select("f", "a", "b", F.lit("copy").alias("op"), F.lit(None).cast("string").alias("field"))
    f["farg"] = stored(f["farg"])
    f["args"] = f["farg"].select(F.col("s").alias("site"), "f", "a", "g", "q")
    f["rets"] = f["farg"].select(F.col("s").alias("site"), "f", "r", "g", F.lit(3).alias("w"), F.lit(False).alias("deep"))
    f["site"] = f["farg"].select("s", "f", "r").distinct()
    f["edge"] = f["farg"].select("s", F.col("g").alias("dst")).distinct()
    f["use"] = f["farg"].select("s", F.col("q").alias("idx"), F.col("a").alias("v"))
    return f


def spec_of(f, args=None) -> DataFrame:
    """The projected roles as a specification: methods by the names that functions have here, their numbers."""
    array = F.lit(None).cast("array<int>") if args is None else F.array(*[F.lit(a) for a in args])
    return f["fspec"].select("name", "role", F.col("f").cast("string").alias("method"), array.alias("args"), F.lit(False).alias("regex"))


def named(func: DataFrame) -> DataFrame:
    return func.select("f", F.col("f").cast("string").alias("name"))


def taint_sql(sanitize: bool = False, arg: str = "", columns: str = "name, source, sink") -> str:
    """Tabulation with matched calls and returns; both orders of the rule that applies what a callee does."""
    clean = "WHERE g NOT IN (SELECT f FROM fspec WHERE role = 'sanitizer')" if sanitize else ""
    return f"""ar AS (SELECT * FROM farg {clean}),
se AS (SELECT DISTINCT s, f.f, r FROM farg f JOIN fspec ON fspec.f = f.g AND role = 'source'),
p(ef, eq, v) USING KEY (ef, eq, v) AS (
  SELECT f, 'S' || CAST(s AS VARCHAR), r::BIGINT FROM se
  UNION (SELECT * FROM (
    SELECT p.ef, p.eq, e.b::BIGINT AS v FROM p JOIN fedge e ON e.f = p.ef AND e.a = p.v
    UNION SELECT ar.g, CAST(ar.q AS VARCHAR), ar.q::BIGINT FROM p JOIN ar ON ar.f = p.ef AND ar.a = p.v
    UNION SELECT ar.f, p.eq, ar.r::BIGINT FROM p JOIN ar ON ar.g = p.ef AND p.v = 3 AND p.eq LIKE 'S%'
    UNION SELECT p.ef, p.eq, ar.r::BIGINT FROM p JOIN ar ON ar.f = p.ef AND ar.a = p.v JOIN recurring.p i ON i.ef = ar.g AND i.eq = CAST(ar.q AS VARCHAR) AND i.v = 3
    UNION SELECT o.ef, o.eq, ar.r::BIGINT FROM p JOIN ar ON ar.g = p.ef AND p.v = 3 AND p.eq = CAST(ar.q AS VARCHAR) JOIN recurring.p o ON o.ef = ar.f AND o.v = ar.a
  ) z WHERE NOT EXISTS (SELECT 1 FROM recurring.p y WHERE y.ef = z.ef AND y.eq = z.eq AND y.v = z.v))),
en(seed, ef, eq) AS (
  SELECT DISTINCT eq, ef, eq FROM p WHERE eq LIKE 'S%'
  UNION SELECT en.seed, ar.g, CAST(ar.q AS VARCHAR) FROM en JOIN p ON p.ef = en.ef AND p.eq = en.eq JOIN ar ON ar.f = p.ef AND ar.a = p.v),
fl AS (SELECT DISTINCT CAST(seed[2:] AS BIGINT) AS source, p.ef AS f, p.v FROM en JOIN p ON p.ef = en.ef AND p.eq = en.eq),
hit AS (SELECT DISTINCT 'rule' AS name, source, u.s AS sink FROM farg u JOIN fspec ON fspec.f = u.g AND role = 'sink' JOIN fl ON fl.f = u.f AND fl.v = u.a {arg})
SELECT {columns} FROM hit"""


NEED = ("fedge", "farg", "fspec")


def run_taint(f, args=None, sanitize=False, how=taint.forward):
    return how(spec_of(f, args), named(f["func"]), f["site"], f["edge"], f["use"], f["edges"], f["args"], f["rets"], **({"sanitize": True} if sanitize else {}))


@query(taint_sql(), *NEED)
def taint_forward(spark, sf_dir):
    return run_taint(flow_inputs(spark, sf_dir))


@query(taint_sql(arg="WHERE u.q = 0"), *NEED)
def taint_args(spark, sf_dir):
    return run_taint(flow_inputs(spark, sf_dir), args=[0])


@query(taint_sql(sanitize=True), *NEED)
def taint_sanitized(spark, sf_dir):
    return run_taint(flow_inputs(spark, sf_dir), sanitize=True)


@query(taint_sql(columns="name, sink, source"), *NEED)
def taint_backward(spark, sf_dir):
    return run_taint(flow_inputs(spark, sf_dir), how=taint.backward)


@query(taint_sql(), *NEED)
def taint_demanded(spark, sf_dir):
    """Taint by what may come to a sink only."""
    f = flow_inputs(spark, sf_dir)
    return taint.forward(spec_of(f), named(f["func"]), f["site"], f["edge"], f["use"], f["edges"], f["args"], f["rets"], demand=True)


@query(
    """d(f, v) AS (
  SELECT DISTINCT farg.f, a::BIGINT FROM farg JOIN fspec ON fspec.f = g AND role = 'sink'
  UNION (SELECT e.f, e.a::BIGINT FROM d JOIN fedge e ON e.f = d.f AND e.b = d.v
    UNION ALL SELECT c.f, c.a::BIGINT FROM d JOIN farg c ON c.g = d.f AND c.q = d.v
    UNION ALL SELECT c.g, 3::BIGINT FROM d JOIN farg c ON c.f = d.f AND c.r = d.v))
SELECT f, v FROM d""",
    *NEED,
)
def value_demand(spark, sf_dir):
    """The values from which something may come to an argument of a sink."""
    f = flow_inputs(spark, sf_dir)
    sinks = f["use"].join(f["edge"], "s").join(f["fspec"].where("role = 'sink'").select(F.col("f").alias("dst")), "dst").join(f["site"].select("s", "f"), "s")
    return flow.demanded(sinks.select("f", "v").distinct(), f["edges"], f["args"], f["rets"]).select("f", F.col("v").cast("long").alias("v"))


#: Rounds as in the operator: what callees do first, each fact with the least last step; then the ways of each seed.
#: Steps are lists (kind, statement, side, function, value, callee's entry and end), which compare from the left.
TRACKED = """se AS (SELECT DISTINCT s, f.f, r FROM farg f JOIN fspec ON fspec.f = f.g AND role = 'source'),
clean AS (SELECT f FROM fspec WHERE role = 'sanitizer'),
en AS (SELECT DISTINCT g, q FROM farg),
p(ef, eq, v, way) USING KEY (ef, eq, v) AS (
  SELECT g, q::BIGINT, q::BIGINT, NULL::BIGINT[] FROM en
  UNION (SELECT ef, eq, v, min(way) FROM (
    SELECT p.ef, p.eq, e.b::BIGINT AS v, [0, 0, p.v, 0, 0]::BIGINT[] AS way FROM p JOIN fedge e ON e.f = p.ef AND e.a = p.v
    UNION ALL SELECT p.ef, p.eq, a.r::BIGINT, [1, a.s, p.v, a.g, a.q]::BIGINT[] FROM p JOIN farg a ON a.f = p.ef AND a.a = p.v JOIN recurring.p i ON i.ef = a.g AND i.eq = a.q AND i.v = 3
    UNION ALL SELECT o.ef, o.eq, a.r::BIGINT, [1, a.s, o.v, a.g, a.q]::BIGINT[] FROM p JOIN farg a ON a.g = p.ef AND a.q = p.eq AND p.v = 3 JOIN recurring.p o ON o.ef = a.f AND o.v = a.a
  ) z WHERE NOT EXISTS (SELECT 1 FROM recurring.p y WHERE y.ef = z.ef AND y.eq = z.eq AND y.v = z.v) GROUP BY ef, eq, v)),
dirty(ef, eq, v) AS (
  SELECT ef, eq, v FROM p WHERE ef IN (SELECT f FROM clean)
  UNION (SELECT p.ef, p.eq, p.v FROM p JOIN dirty d ON d.ef = p.ef AND d.eq = p.eq AND d.v = p.way[3]
    UNION ALL SELECT p.ef, p.eq, p.v FROM p JOIN dirty d ON p.way[1] = 1 AND d.ef = p.way[4] AND d.eq = p.way[5] AND d.v = 3)),
t(f0, v0, o, f, v, dist, way) USING KEY (f0, v0, o, f, v) AS (
  SELECT DISTINCT f, r::BIGINT, 1::BIGINT, f, r::BIGINT, 0, NULL::BIGINT[] FROM se
  UNION (SELECT f0, v0, o, f, v, min(dist) + 1, min(way) FROM (
    SELECT t.f0, t.v0, t.o, t.f, e.b::BIGINT AS v, dist, [0, 0, t.o, t.f, t.v, 0, 0]::BIGINT[] AS way FROM t JOIN fedge e ON e.f = t.f AND e.a = t.v
    UNION ALL SELECT t.f0, t.v0, t.o, t.f, a.r, dist, [1, a.s, t.o, t.f, t.v, a.g, a.q] FROM t JOIN farg a ON a.f = t.f AND a.a = t.v JOIN p i ON i.ef = a.g AND i.eq = a.q AND i.v = 3
    UNION ALL SELECT t.f0, t.v0, 1, a.f, a.r, dist, [2, a.s, t.o, t.f, t.v, 0, 0] FROM t JOIN farg a ON a.g = t.f AND t.v = 3 AND t.o = 1
    UNION ALL SELECT t.f0, t.v0, 0, a.g, a.q, dist, [3, a.s, t.o, t.f, t.v, 0, 0] FROM t JOIN farg a ON a.f = t.f AND a.a = t.v
  ) z WHERE NOT EXISTS (SELECT 1 FROM recurring.t y WHERE y.f0 = z.f0 AND y.v0 = z.v0 AND y.o = z.o AND y.f = z.f AND y.v = z.v) GROUP BY f0, v0, o, f, v)),
u AS (SELECT DISTINCT u.s AS sink, u.f, u.a AS v FROM farg u JOIN fspec ON fspec.f = u.g AND role = 'sink'),
h AS (SELECT f0, v0, sink, dist, o, t.f, t.v FROM t JOIN u ON u.f = t.f AND u.v = t.v
  QUALIFY row_number() OVER (PARTITION BY f0, v0, sink ORDER BY dist, o, t.v) = 1),
b(f0, v0, sink, back, o, f, v, way) AS (
  SELECT h.f0, h.v0, h.sink, 0, h.o, h.f, h.v, t.way FROM h JOIN t USING (f0, v0, o, f, v)
  UNION ALL SELECT b.f0, b.v0, b.sink, back + 1, t.o, t.f, t.v, t.way FROM b JOIN t ON t.f0 = b.f0 AND t.v0 = b.v0 AND t.o = b.way[3] AND t.f = b.way[4] AND t.v = b.way[5]),
w AS (SELECT b.f0, b.v0, sink, max(back) AS length, string_agg(concat(b.f, ':', b.v), ' ' ORDER BY back DESC) AS path,
    bool_or(c.f IS NOT NULL OR d.ef IS NOT NULL) AS sanitized
  FROM b LEFT JOIN clean c ON c.f = b.f LEFT JOIN dirty d ON b.way[1] = 1 AND d.ef = b.way[6] AND d.eq = b.way[7] AND d.v = 3 GROUP BY b.f0, b.v0, sink)
SELECT 'rule' AS name, s AS source, sink, length::INTEGER AS length, sanitized, path FROM w JOIN se ON se.f = w.f0 AND se.r = w.v0"""


@query(TRACKED, *NEED)
def taint_paths(spark, sf_dir):
    found = run_taint(flow_inputs(spark, sf_dir), how=taint.tracked)
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: F.concat_ws(":", x["f"].cast("string"), x["v"])), " "))


PATTERNS = [("greens", "source", ".*green.*"), ("small", "sink", "[a-m].*"), ("none", "sink", "no such")]


@query(
    """x(name, role, method) AS (VALUES ('greens', 'source', '.*green.*'), ('small', 'sink', '[a-m].*'), ('none', 'sink', 'no such'))
SELECT DISTINCT x.name, x.role, f FROM func JOIN x ON regexp_full_match(func.name, x.method)""",
    "func",
)
def taint_regex(spark, sf_dir):
    f = facts(spark, sf_dir, "func")
    spec = spark.createDataFrame([(n, r, m, None, True) for n, r, m in PATTERNS], "name string, role string, method string, args array<int>, regex boolean")
    return taint.matched(spec, f["func"]).select("name", "role", "f")


# --- typestate ---------------------------------------------------------------------------------

SESSION = [("NEW", "signup", "OPEN"), ("OPEN", "view", "BROWSING"), ("BROWSING", "click", "OPEN"), ("OPEN", "error", "ERR"), ("BROWSING", "error", "ERR"), ("BROWSING", "purchase", "CLOSED"), ("CLOSED", "signup", "OPEN")]


@query(
    """tr(src, event, dst) AS (VALUES {values}),
r AS (SELECT obj, 0::BIGINT AS ord, 'NEW' AS state, NULL::BIGINT AS changed FROM (SELECT DISTINCT obj FROM trace)
  UNION ALL SELECT r.obj, t.ord, coalesce(tr.dst, r.state), CASE WHEN tr.dst IS NOT NULL AND tr.dst <> r.state THEN t.ord ELSE r.changed END
  FROM r JOIN trace t ON t.obj = r.obj AND t.ord = r.ord + 1 LEFT JOIN tr ON tr.src = r.state AND tr.event = t.event)
SELECT obj, max_by(state, ord) AS state, arg_max_null(changed, ord) AS changed FROM r GROUP BY obj""".replace("{values}", ", ".join(f"('{a}', '{e}', '{b}')" for a, e, b in SESSION)),
    "trace",
)
def typestate_fsm(spark, sf_dir):
    return typestate.final_states(facts(spark, sf_dir, "trace")["trace"], SESSION, "NEW")


def location_events(trace: DataFrame) -> DataFrame:
    """Events of users as calls of a location service: filters by the nearest one that there is."""
    near = typestate.nearest_filter((F.col("ord") * 37 + F.col("obj")) % 70000)
    name = F.when(F.col("event") == "view", F.concat(F.lit("setFilter:"), near.cast("string"))).when(F.col("event") == "click", "start").when(F.col("event") == "purchase", "stop")
    accuracy = F.element_at(F.array(*[F.lit(a) for a in typestate.ACCURACIES]), (F.col("ord") % 4 + 1).cast("int"))
    return trace.withColumn("event", name.when(F.col("event") == "signup", F.concat(F.lit("setAccuracy:"), accuracy)).otherwise("other"))


def machine_sql(machine) -> str:
    moves, states, initial = machine()
    return (
        "tr(src, event, dst) AS (VALUES " + ", ".join(f"('{a}', '{e}', '{b}')" for a, e, b in moves) + "), "
        "st(name, error) AS (VALUES " + ", ".join(f"('{n}', {str(e).lower()})" for n, e in states) + ")"
    ), initial


_moves, _initial = machine_sql(typestate.standard_machine)


@query(
    f"""{_moves}, nf AS (SELECT obj, ord, event, (ord * 37 + obj) % 70000 AS d FROM trace),
ev AS (SELECT obj, ord, CASE event WHEN 'view' THEN 'setFilter:' || CASE WHEN d <= 136 THEN '16' WHEN d <= 2176 THEN '256' WHEN d <= 34816 THEN '4096' ELSE '65536' END
  WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'stop'
  WHEN 'signup' THEN 'setAccuracy:' || ['Best', 'Hundred', 'Kilometer', 'Navigation'][ord % 4 + 1] ELSE 'other' END AS event FROM nf),
r AS (SELECT obj, 0::BIGINT AS ord, '{_initial}' AS state FROM (SELECT DISTINCT obj FROM trace)
  UNION ALL SELECT r.obj, t.ord, coalesce(tr.dst, r.state) FROM r JOIN ev t ON t.obj = r.obj AND t.ord = r.ord + 1 LEFT JOIN tr ON tr.src = r.state AND tr.event = t.event),
e AS (SELECT obj, max_by(state, ord) AS state FROM r GROUP BY obj)
SELECT obj, state FROM e WHERE state IN (SELECT name FROM st WHERE error)""",
    "trace",
)
def typestate_location(spark, sf_dir):
    moves, states, initial = typestate.MACHINES["StandardLocationService"]()
    events = location_events(facts(spark, sf_dir, "trace")["trace"])
    finals = typestate.final_states(events, moves, initial)
    state = spark.createDataFrame([(n, e, f"error in {n}" if e else None, 1) for n, e in states], "name string, error boolean, message string, severity int")
    return typestate.errors(finals, state).select("obj", "state")


_vmoves, _vinitial = machine_sql(typestate.visits_machine)


@query(
    f"""{_vmoves}, ev AS (SELECT obj, ord, CASE event WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'stop'
  WHEN 'view' THEN 'setActivity:' || ['other', 'automotiveNavigation', 'fitness', 'otherNavigation', 'airborne'][ord % 5 + 1] ELSE 'other' END AS event FROM trace),
r AS (SELECT obj, 0::BIGINT AS ord, '{_vinitial}' AS state FROM (SELECT DISTINCT obj FROM trace)
  UNION ALL SELECT r.obj, t.ord, coalesce(tr.dst, r.state) FROM r JOIN ev t ON t.obj = r.obj AND t.ord = r.ord + 1 LEFT JOIN tr ON tr.src = r.state AND tr.event = t.event),
e AS (SELECT obj, max_by(state, ord) AS state FROM r GROUP BY obj)
SELECT obj, state FROM e WHERE state IN (SELECT name FROM st WHERE error)""",
    "trace",
)
def typestate_visits(spark, sf_dir):
    moves, states, initial = typestate.MACHINES["VisitsService"]()
    activity = F.element_at(F.array(*[F.lit(a) for a in typestate.ACTIVITIES]), (F.col("ord") % 5 + 1).cast("int"))
    name = F.when(F.col("event") == "click", "start").when(F.col("event") == "purchase", "stop").when(F.col("event") == "view", F.concat(F.lit("setActivity:"), activity)).otherwise("other")
    finals = typestate.final_states(facts(spark, sf_dir, "trace")["trace"].withColumn("event", name), moves, initial)
    state = spark.createDataFrame([(n, e, None, 1) for n, e in states], "name string, error boolean, message string, severity int")
    return typestate.errors(finals, state).select("obj", "state")


# --- crypto ------------------------------------------------------------------------------------

ORIGINS = """fl AS (SELECT node, what, kind FROM vseed UNION SELECT e.dst, fl.what, fl.kind FROM fl JOIN vedge e ON e.src = fl.node),
cs AS (SELECT DISTINCT s AS site, [1, 2, 3, 4, 5, 7][1 + i % 6] AS rule, f * 4 + nargs AS arg FROM site),
og AS (SELECT s AS site, f * 4 + nargs AS arg, fl.what, fl.kind FROM site JOIN fl ON fl.node = f * 4 + nargs)
"""


def crypto_inputs(spark, sf_dir):
    from ..operators.callgraph import reaching

    f = facts(spark, sf_dir, "site", "vseed", "vedge")
    flows = reaching(f["vseed"], f["vedge"])
    rules = F.array(*[F.lit(r) for r in crypto.RULES])
    node = (F.col("f") * 4 + F.col("nargs")).alias("arg")
    sites = stored(f["site"].select(F.col("s").alias("site"), F.element_at(rules, (F.col("i") % 6 + 1).cast("int")).alias("rule"), node).distinct())
    kind = F.when(F.col("kind") == "class", "literal").otherwise("result").alias("kind")
    at = f["site"].select(F.col("s").alias("site"), node)
    origin = at.join(flows.withColumnRenamed("node", "arg"), "arg").select("site", "arg", kind, F.lit(None).cast("string").alias("lit_str"), (F.col("what") * 5000).alias("lit_int"), F.col("what").cast("string").alias("func"))
    return sites, stored(origin.distinct())


@query(ORIGINS + "SELECT cs.site, rule, cs.arg, count(DISTINCT what) AS n FROM cs JOIN og ON og.site = cs.site AND og.arg = cs.arg AND kind = 'class' GROUP BY cs.site, rule, cs.arg", "site", "vseed", "vedge")
def crypto_const(spark, sf_dir):
    return crypto.constants(*crypto_inputs(spark, sf_dir)).drop("found")


@query(ORIGINS + "SELECT cs.site, rule, cs.arg, min(what * 5000) AS least FROM cs JOIN og ON og.site = cs.site AND og.arg = cs.arg AND kind = 'class' AND what * 5000 < 100000 WHERE rule = 5 GROUP BY cs.site, rule, cs.arg", "site", "vseed", "vedge")
def crypto_low_iter(spark, sf_dir):
    return crypto.few_iterations(*crypto_inputs(spark, sf_dir))


@query(ORIGINS + "SELECT site, rule, arg FROM cs WHERE rule = 2 AND (site, arg) NOT IN (SELECT (site, arg) FROM og WHERE kind = 'func' AND what % 2 = 0)", "site", "vseed", "vedge")
def crypto_origin(spark, sf_dir):
    sites, origin = crypto_inputs(spark, sf_dir)
    random = origin.where("kind = 'result' and cast(func as bigint) % 2 = 0").select("func").distinct()
    return crypto.not_from_functions(sites.where("rule = 2"), origin, random)


@query(
    ORIGINS
    + """SELECT rule, CASE rule WHEN 1 THEN 'ECB' WHEN 2 THEN 'IV' WHEN 3 THEN 'KEY' WHEN 4 THEN 'SALT' WHEN 5 THEN 'ITERATION' ELSE 'PASSWORD' END AS name, site, arg FROM cs WHERE
(rule IN (3, 4, 7) AND (site, arg) IN (SELECT (site, arg) FROM og WHERE kind = 'class'))
OR (rule = 1 AND (site, arg) IN (SELECT (site, arg) FROM og WHERE kind = 'func' AND what % 3 = 0))
OR (rule = 2 AND (site, arg) NOT IN (SELECT (site, arg) FROM og WHERE kind = 'func' AND what % 2 = 0))
OR (rule = 5 AND (site, arg) IN (SELECT (site, arg) FROM og WHERE kind = 'class' AND what * 5000 < 100000))""",
    "site",
    "vseed",
    "vedge",
)
def crypto_rules(spark, sf_dir):
    sites, origin = crypto_inputs(spark, sf_dir)
    some = lambda k: origin.where(f"kind = 'result' and cast(func as bigint) % {k} = 0").select("func").distinct()
    return crypto.violations(sites, origin, some(2), some(3)).select("rule", "name", "site", "arg")


@query(
    ORIGINS
    + """, li AS (SELECT cs.site, rule, cs.arg, array_to_string(list_sort(list(DISTINCT CAST(what * 5000 AS VARCHAR))), ',') AS found FROM cs JOIN og ON og.site = cs.site AND og.arg = cs.arg AND kind = 'class'
  WHERE rule IN (3, 4, 7) GROUP BY cs.site, rule, cs.arg),
ar AS (SELECT DISTINCT cs.site, rule, cs.arg FROM cs JOIN og ON og.site = cs.site AND og.arg = cs.arg AND kind = 'func' AND what % 5 = 0 WHERE rule IN (3, 4, 7))
SELECT rule, site, arg, found FROM li UNION ALL SELECT rule, site, arg, NULL FROM ar WHERE (rule, site, arg) NOT IN (SELECT (rule, site, arg) FROM li)""",
    "site",
    "vseed",
    "vedge",
)
def crypto_arrays(spark, sf_dir):
    """Constant keys, salts and passwords: the literals found, and arrays written out in the program."""
    sites, origin = crypto_inputs(spark, sf_dir)
    none, arrays = origin.select("func").where("false"), origin.where("kind = 'result' and cast(func as bigint) % 5 = 0").select("func").distinct()
    return crypto.violations(sites.where("rule in (3, 4, 7)"), origin, none, none, arrays).select("rule", "site", "arg", F.array_join("found", ",").alias("found"))


@query(
    """st AS (SELECT s, f, block, row_number() OVER (PARTITION BY f, block ORDER BY s) AS ord, i % 3 AS kind, i % 4 AS tag, i FROM site),
nx AS (SELECT *, lead(kind) OVER (PARTITION BY f, block ORDER BY ord) AS nk, lead(tag) OVER (PARTITION BY f, block ORDER BY ord) AS nt FROM st)
SELECT DISTINCT c.s AS site, c.i AS arg FROM nx m JOIN site c ON c.f = m.f AND c.i % 7 = m.i % 7 WHERE m.kind = 0 AND m.nk = 1 AND m.nt = 0""",
    "site",
)
def crypto_enums(spark, sf_dir):
    """Arguments that an allocation of an enumeration in ECB mode reaches: its tag is the literal directly after it."""
    s = stored(facts(spark, sf_dir, "site")["site"])
    order = Window.partitionBy("f", "block").orderBy("s")
    kind, tag = F.element_at(F.array(F.lit("new"), F.lit("literal"), F.lit("apply")), (F.col("i") % 3 + 1).cast("int")), F.when(F.col("i") % 4 == 0, crypto.ECB_TAG).otherwise("other")
    stmt = s.select(F.col("s").alias("stmt_id"), F.col("f").alias("func"), F.col("block").alias("block_ord"), F.row_number().over(order).alias("ord"), kind.alias("kind"), F.col("i").alias("result"), tag.alias("lit_str"))
    tags = crypto.enum_tags(stmt).where(F.col("tag") == crypto.ECB_TAG)
    near = s.select(F.col("f"), (F.col("i") % 7).alias("k"), F.col("s").alias("site"), F.col("i").alias("arg"))
    origin = near.join(s.select("f", (F.col("i") % 7).alias("k"), F.col("s").alias("made")), ["f", "k"]).select("site", "arg", F.lit("allocation").alias("kind"), "made")
    return crypto.from_tags(near.select("site", F.lit(1).alias("rule"), "arg"), origin, tags).select("site", "arg").distinct()


@query(
    """n AS (SELECT f * 4 + k AS n FROM func, (SELECT unnest([0, 1, 2, 3]) AS k) ks),
c AS (SELECT f * 4 + a AS src, f * 4 + b AS dst FROM ffield WHERE op = 0),
x AS (SELECT f * 4 + a AS obj, field, f * 4 + b AS n FROM ffield WHERE op = 1 UNION SELECT f * 4 + b, field, f * 4 + a FROM ffield WHERE op = 2),
e(a, b) AS (
  SELECT n, n FROM n
  UNION (SELECT e.a, c.dst FROM e JOIN c ON c.src = e.b UNION ALL SELECT e.a, c.src FROM e JOIN c ON c.dst = e.b
    UNION ALL SELECT e.b, e.a FROM e
    UNION ALL SELECT d.a, e.b FROM e JOIN recurring.e d ON d.b = e.a UNION ALL SELECT e.a, d.b FROM e JOIN recurring.e d ON d.a = e.b
    UNION ALL SELECT x.n, y.n FROM e JOIN x ON x.obj = e.a JOIN x y ON y.obj = e.b AND y.field = x.field))
SELECT a AS n, min(b) AS root FROM e GROUP BY a""",
    "ffield",
    "func",
)
def alias_congruence(spark, sf_dir):
    """Classes of values joined by copies, and by equal fields of objects of one class, until nothing more is joined."""
    f = facts(spark, sf_dir, "ffield", "func")
    at = lambda c: (F.col("f") * 4 + F.col(c))
    value = f["func"].select(F.explode(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.col("f") * 4 + k)).alias("n"))
    field = stored(f["ffield"])
    copy = field.where("op = 0").select(at("a").alias("src"), at("b").alias("dst"))
    load, store = field.where("op = 1").select(at("a").alias("obj"), "field", at("b").alias("n")), field.where("op = 2").select(at("b").alias("obj"), "field", at("a").alias("n"))
    return unify.alias_classes(value, copy, load.unionByName(store).distinct()).select("n", "root")


# --- modules, lowering, control flow ---------------------------------------------------------------

#: Three parts, or two, are versions of one function.
THIRD = "(SELECT CAST(floor((count(*) + 2) / 3.0) AS BIGINT) FROM part)"
VERSIONS = f"""ver AS (SELECT p_partkey % {THIRD} AS func, p_partkey AS ord, ['none', 'stub', 'model', 'stub', 'none', 'model'][1 + p_size % 6] AS attr FROM part)"""


@query(
    VERSIONS
    + """, a AS (SELECT func, ord, attr, row_number() OVER (PARTITION BY func ORDER BY ord) AS k FROM ver),
s1 AS (SELECT func, CASE WHEN attr = 'model' THEN 'absent' ELSE attr END AS st, CASE WHEN attr = 'model' THEN NULL ELSE ord END AS body FROM a WHERE k = 1),
step(st, attr, nst, own) AS (VALUES ('absent','none','none',true), ('absent','stub','stub',true), ('absent','model','absent',false),
 ('none','none','none',false), ('none','stub','linked',false), ('none','model','modelOverride',true),
 ('stub','none','linked',true), ('stub','stub','stub',false), ('stub','model','model',true),
 ('linked','none','linked',false), ('linked','stub','linked',false), ('linked','model','modelOverride',true),
 ('modelOverride','none','modelOverride',false), ('modelOverride','stub','error',false), ('modelOverride','model','error',false),
 ('model','none','error',false), ('model','stub','error',false), ('model','model','error',false),
 ('error','none','error',false), ('error','stub','error',false), ('error','model','error',false)),
s2 AS (SELECT s1.func, nst AS st, CASE WHEN own THEN a.ord ELSE body END AS body FROM s1 JOIN a ON a.func = s1.func AND a.k = 2 JOIN step ON step.st = s1.st AND step.attr = a.attr
  UNION ALL SELECT * FROM s1 WHERE func NOT IN (SELECT func FROM a WHERE k = 2)),
s3 AS (SELECT s2.func, nst AS st, CASE WHEN own THEN a.ord ELSE body END AS body FROM s2 JOIN a ON a.func = s2.func AND a.k = 3 JOIN step ON step.st = s2.st AND step.attr = a.attr
  UNION ALL SELECT * FROM s2 WHERE func NOT IN (SELECT func FROM a WHERE k = 3))
SELECT func, st AS state, body FROM s3 WHERE st <> 'absent'""",
    "func",
)
def module_merge(spark, sf_dir):
    facts(spark, sf_dir, "func")
    versions = spark.sql(
        f"SELECT p_partkey % {THIRD} AS func, p_partkey AS ord, element_at(array('none', 'stub', 'model', 'stub', 'none', 'model'), CAST(1 + p_size % 6 AS INT)) AS attr FROM part"
    )
    return merge.merged(versions).select("func", "state", "body")


STMTS = "st AS (SELECT s AS stmt_id, f AS func, block AS block_ord, row_number() OVER (PARTITION BY f, block ORDER BY s) AS ord, i, kind FROM site)"


def statements(spark, sf_dir):
    facts(spark, sf_dir, "site")
    return spark.sql(f"WITH {with_facts('site')}, {STMTS} SELECT * FROM st")


@query(f"{STMTS}, n AS (SELECT func, stmt_id AS src, lead(stmt_id) OVER (PARTITION BY func, block_ord ORDER BY ord) AS dst FROM st), "
    "l AS (SELECT func, block_ord, max(stmt_id) AS src FROM st GROUP BY func, block_ord), h AS (SELECT func, block_ord, min(stmt_id) AS dst FROM st GROUP BY func, block_ord) "
    "SELECT func, src, dst FROM n WHERE dst IS NOT NULL UNION ALL SELECT l.func, src, dst FROM l JOIN h ON h.func = l.func AND h.block_ord = (l.block_ord + 1) % 4", "site")  # fmt: skip
def stmt_cfg(spark, sf_dir):
    s = statements(spark, sf_dir)
    jumps = s.select("func", F.col("block_ord").alias("src"), ((F.col("block_ord") + 1) % 4).alias("dst")).distinct()
    return lowering.statement_edges(s, jumps)


@query(f"{STMTS}, b AS (SELECT DISTINCT func, block_ord FROM st) SELECT func, block_ord AS src, lead(block_ord) OVER (PARTITION BY func ORDER BY block_ord) AS dst FROM b QUALIFY dst IS NOT NULL", "site")
def block_cfg(spark, sf_dir):
    return lowering.fall_through(statements(spark, sf_dir).select("func", "block_ord").distinct())


@query(
    f"""{STMTS}, p AS (SELECT stmt_id, func, block_ord, i % 3 AS idx, i AS val FROM st),
q AS (SELECT DISTINCT func, block_ord AS label, idx, func * 10 + block_ord * 3 + idx AS sym FROM p)
SELECT p.func, p.stmt_id, q.sym, p.val FROM p JOIN q ON q.func = p.func AND q.label = (p.block_ord + 1) % 4 AND q.idx = p.idx""",
    "site",
)
def phi_lowering(spark, sf_dir):
    s = statements(spark, sf_dir)
    passed = s.select("stmt_id", "func", ((F.col("block_ord") + 1) % 4).alias("label"), (F.col("i") % 3).alias("idx"), F.col("i").alias("val"))
    params = s.select("func", F.col("block_ord").alias("label"), (F.col("i") % 3).alias("idx")).distinct().withColumn("sym", F.col("func") * 10 + F.col("label") * 3 + F.col("idx"))
    return lowering.phi_assignments(passed, params)


@query(
    """x AS (SELECT s, f, CASE WHEN target % 5 = 0 THEN 'reabstraction thunk helper from ' || CAST(target AS STRING) ELSE 'plain ' || CAST(target AS STRING) END AS callee, i AS arg,
CASE WHEN i % 4 = 0 THEN 'fn ' || CAST(i AS STRING) END AS arg_fn FROM site WHERE kind < 2)
SELECT s, f, CASE WHEN NOT starts_with(callee, 'reabstraction thunk helper from ') THEN 'apply' WHEN arg_fn IS NOT NULL THEN 'apply direct' ELSE 'assign' END AS kind,
CASE WHEN starts_with(callee, 'reabstraction thunk helper from ') THEN arg_fn ELSE callee END AS callee FROM x""",
    "site",
)
def thunk_removal(spark, sf_dir):
    s = facts(spark, sf_dir, "site")["site"].where("kind < 2")
    callee = F.when(F.col("target") % 5 == 0, F.concat(F.lit("reabstraction thunk helper from "), F.col("target").cast("string"))).otherwise(F.concat(F.lit("plain "), F.col("target").cast("string")))
    calls = s.select("s", "f", callee.alias("callee"), F.when(F.col("i") % 4 == 0, F.concat(F.lit("fn "), F.col("i").cast("string"))).alias("arg_fn"))
    return lowering.without_thunks(calls)


@query(
    """x AS (SELECT f AS func, i AS sym, s, ['new', 'pointer_read', 'pointer_write', 'store', 'pass'][1 + kind % 5] AS use FROM site),
e AS (SELECT func, sym FROM x WHERE use IN ('store', 'pass')), p AS (SELECT func, sym FROM x WHERE use IN ('pointer_read', 'pointer_write'))
SELECT DISTINCT func, sym FROM x WHERE (func, sym) IN (SELECT (func, sym) FROM p) AND (func, sym) NOT IN (SELECT (func, sym) FROM e)""",
    "site",
)
def pointer_promotion(spark, sf_dir):
    s = facts(spark, sf_dir, "site")["site"]
    use = F.element_at(F.array(*[F.lit(x) for x in ("new", "pointer_read", "pointer_write", "store", "pass")]), (F.col("kind") % 5 + 1).cast("int"))
    return lowering.promotable(s.select(F.col("f").alias("func"), F.col("i").alias("sym"), use.alias("use")))


# --- annotations -----------------------------------------------------------------------------------

NOTES = """res AS (SELECT l_orderkey AS line, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'F'),
note AS (SELECT l_orderkey AS line, l_returnflag AS kind, CASE WHEN l_linenumber = 1 THEN 'fn' WHEN l_linenumber = 2 THEN 'fp' END AS status FROM lineitem WHERE l_linestatus = 'O'),
a AS (SELECT line, kind, row_number() OVER (PARTITION BY line, kind) AS k FROM res),
b AS (SELECT line, kind, status, row_number() OVER (PARTITION BY line, kind ORDER BY status NULLS FIRST) AS k FROM note)
"""


@query(
    "WITH " + NOTES
    + """, j AS (SELECT coalesce(a.line, b.line) AS line, coalesce(a.kind, b.kind) AS kind, a.k AS r, b.k AS n, b.status FROM a FULL JOIN b ON a.line = b.line AND a.kind = b.kind AND a.k = b.k),
v AS (SELECT line, kind, CASE WHEN n IS NULL AND line NOT IN (SELECT line FROM note) THEN 'unexpected' WHEN n IS NULL AND (line, kind) IN (SELECT (line, kind) FROM note) THEN 'unexpected'
 WHEN n IS NULL THEN 'ignored' WHEN r IS NULL AND status = 'fn' THEN 'known miss' WHEN r IS NULL THEN 'missed' WHEN status = 'fn' THEN 'found after all' ELSE 'ok' END AS verdict FROM j)
SELECT verdict, count(*) AS n FROM v GROUP BY verdict"""
)
def annotation_check(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    result = spark.sql("SELECT l_orderkey AS line, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'F'").selectExpr("'main' AS path", "line", "'rule' AS name", "kind")
    note = spark.sql(
        "SELECT l_orderkey AS line, l_returnflag AS kind, CASE WHEN l_linenumber = 1 THEN 'fn' WHEN l_linenumber = 2 THEN 'fp' END AS status FROM lineitem WHERE l_linestatus = 'O'"
    ).selectExpr("'main' AS path", "line", "'rule' AS name", "kind", "status")
    return annotations.checked(result, note).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
