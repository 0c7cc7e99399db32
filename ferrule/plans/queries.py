"""The program-fact operators as queries over facts projected from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, dispatch, graphs, weights
from ..sources.projection import INDEX, METHOD, facts, with_facts
from .store import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str, recursive: bool = True):
    """Register a query under its function's name; sql may use the named facts."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{with_facts(*names)}" if names else ""
            ORACLES[function.__name__] = f"{head}{', ' if names and not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"
        return function

    return add


def split_graphs(f: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A larger graph and a smaller one, which lacks calls into every seventh function and half of the entries."""
    return f["entry"], f["call"], f["entry"].where("f % 2 = 0"), f["call"].where("dst % 7 <> 0")


SPLIT = """sup AS (SELECT src, dst FROM call), sub AS (SELECT src, dst FROM call WHERE dst % 7 <> 0),
sup_e AS (SELECT f FROM entry), sub_e AS (SELECT f FROM entry WHERE f % 2 = 0),
sup_r AS (SELECT f FROM sup_e UNION SELECT dst FROM sup_r JOIN sup ON sup.src = sup_r.f),
sub_r AS (SELECT f FROM sub_e UNION SELECT dst FROM sub_r JOIN sub ON sub.src = sub_r.f)
"""


# --- reachability and comparisons ------------------------------------------------------------


@query("r AS (SELECT f FROM entry UNION SELECT dst FROM r JOIN call ON src = f) SELECT f FROM r", "entry", "call")
def reachable_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, "entry", "call")
    return graphs.reachable(f["entry"], f["call"])


@query(
    """r(f, dist) AS (SELECT f, 0 FROM entry UNION SELECT dst, dist + 1 FROM r JOIN call ON src = f WHERE dist < 60),
d AS (SELECT f, min(dist) AS dist FROM r GROUP BY f)
SELECT d.f, d.dist, min(p.f) AS prev FROM d LEFT JOIN call ON call.dst = d.f AND d.dist > 0 LEFT JOIN d p ON p.f = call.src AND p.dist = d.dist - 1 GROUP BY d.f, d.dist""",
    "entry",
    "call",
)
def shortest_paths(spark, sf_dir):
    f = facts(spark, sf_dir, "entry", "call")
    return graphs.shortest_paths(f["entry"], f["call"])


@query(
    """r AS (SELECT src AS a, dst AS b FROM ddg_edge UNION SELECT r.a, e.dst FROM r JOIN ddg_edge e ON e.src = r.b)
SELECT a AS src, b AS dst FROM r""",
    "ddg_edge",
)
def ddg_closure(spark, sf_dir):
    return dispatch.reach(facts(spark, sf_dir, "ddg_edge")["ddg_edge"])


@query(
    f"""r AS (SELECT src AS a, dst AS b FROM ddg_edge UNION SELECT r.a, e.dst FROM r JOIN ddg_edge e ON e.src = r.b)
SELECT DISTINCT e.src - {INDEX} AS i, e.dst - {METHOD} AS m FROM ddg_edge e JOIN r ON r.a = e.dst JOIN alloc ON alloc.c = r.b WHERE e.src BETWEEN {INDEX} AND {METHOD} - 1""",
    "ddg_edge",
    "alloc",
)
def ddg_dispatch(spark, sf_dir):
    f = facts(spark, sf_dir, "ddg_edge", "alloc")
    e = f["ddg_edge"]
    index_method = e.where(F.col("src").between(INDEX, METHOD - 1)).select((F.col("src") - INDEX).alias("i"), (F.col("dst") - METHOD).alias("m"))
    method_class = dispatch.reach(e).where(F.col("src") >= METHOD).select((F.col("src") - METHOD).alias("m"), F.col("dst").alias("c"))
    return dispatch.targets(index_method, method_class, f["alloc"].select("c").distinct())


@query("SELECT DISTINCT a.i, b.c, a.m FROM dispatch a JOIN dispatch b ON b.m = a.m", "dispatch")
def ddg_class_targets(spark, sf_dir):
    d = facts(spark, sf_dir, "dispatch")["dispatch"]
    return dispatch.class_targets(d.select("i", "m"), d.select("m", "c"))


@query("SELECT f FROM entry WHERE f NOT IN (SELECT dst FROM call)", "entry", "call")
def prune_entries(spark, sf_dir):
    f = facts(spark, sf_dir, "entry", "call")
    return graphs.prune_entries(f["entry"], f["call"])


@query("SELECT f, CASE WHEN f IN (SELECT f FROM entry) THEN 'entry' ELSE 'dead' END AS state FROM func WHERE f NOT IN (SELECT dst FROM call)", "func", "entry", "call")
def dead_funcs(spark, sf_dir):
    f = facts(spark, sf_dir, "func", "entry", "call")
    return graphs.dead(f["func"], f["entry"], f["call"])


@query(
    """r AS (SELECT f FROM entry UNION SELECT dst FROM r JOIN call ON src = f)
SELECT (SELECT count(*) FROM entry) AS entries, (SELECT count(*) FROM call) AS edges,
  (SELECT count(*) FROM (SELECT f FROM entry UNION SELECT src FROM call UNION SELECT dst FROM call)) AS methods,
  (SELECT count(*) FROM r) AS reachable, (SELECT count(*) FROM call WHERE src IN (SELECT f FROM r)) AS reachable_edges""",
    "entry",
    "call",
)
def graph_info(spark, sf_dir):
    f = facts(spark, sf_dir, "entry", "call")
    return graphs.graph_info(f["entry"], f["call"])


@query(
    SPLIT
    + """SELECT 'entry' AS kind, NULL::BIGINT AS src, f AS dst FROM (SELECT f FROM sup_e EXCEPT SELECT f FROM sub_e)
UNION ALL SELECT 'edge', src, dst FROM (SELECT src, dst FROM sup EXCEPT SELECT src, dst FROM sub) WHERE src IN (SELECT f FROM sub_r)""",
    "entry",
    "call",
)
def cg_diff(spark, sf_dir):
    return graphs.difference(*split_graphs(facts(spark, sf_dir, "entry", "call")))


@query(SPLIT + "SELECT f FROM sup_r EXCEPT SELECT f FROM sub_r", "entry", "call")
def cg_missing_methods(spark, sf_dir):
    return graphs.missing_methods(*split_graphs(facts(spark, sf_dir, "entry", "call")))


SITES = """big AS (SELECT f AS src, i AS context, m AS dst FROM (SELECT DISTINCT f, s.i, d.m FROM site s JOIN dispatch d ON d.i = s.i WHERE kind > 1)),
small AS (SELECT * FROM big WHERE dst IN (SELECT m FROM dispatch JOIN alloc ON alloc.c = dispatch.c AND alloc.f % 3 = 0))
"""


def site_graphs(f):
    big = f["site"].where("kind > 1").select("f", "i").distinct().join(f["dispatch"].select("i", "m").distinct(), "i").select(F.col("f").alias("src"), F.col("i").alias("context"), F.col("m").alias("dst"))
    live = f["dispatch"].join(f["alloc"].where("f % 3 = 0").select("c"), "c", "left_semi").select(F.col("m").alias("dst"))
    return big, big.join(live, "dst", "left_semi")


@query(
    SITES
    + """, r AS (SELECT f FROM entry UNION SELECT dst FROM r JOIN small ON src = f),
a AS (SELECT context, CASE WHEN count(DISTINCT dst) > 1 THEN 'poly' ELSE 'mono' END AS k FROM big GROUP BY context),
b AS (SELECT context, CASE WHEN count(DISTINCT dst) > 1 THEN 'poly' ELSE 'mono' END AS k FROM small GROUP BY context),
live AS (SELECT DISTINCT context FROM small WHERE src IN (SELECT f FROM r))
SELECT coalesce(a.k, 'absent') AS before, CASE WHEN b.k IS NULL THEN 'absent' WHEN live.context IS NULL THEN b.k || ' unreachable' ELSE b.k END AS after, count(*) AS n
FROM a FULL JOIN b ON a.context = b.context LEFT JOIN live ON live.context = coalesce(a.context, b.context) GROUP BY 1, 2""",
    "site",
    "dispatch",
    "alloc",
    "entry",
)
def cg_diff_stats(spark, sf_dir):
    f = facts(spark, sf_dir, "site", "dispatch", "alloc", "entry")
    big, small = site_graphs(f)
    return graphs.diff_stats(big, small, f["entry"])


@query(
    SITES
    + """, a AS (SELECT context, list(DISTINCT dst) AS t FROM big GROUP BY context HAVING count(DISTINCT dst) > 1),
b AS (SELECT context, list(DISTINCT dst) AS t FROM small GROUP BY context),
c AS (SELECT len([x for x in a.t if NOT list_contains(coalesce(b.t, []), x)]) AS fewer, len([x for x in coalesce(b.t, []) if NOT list_contains(a.t, x)]) AS more FROM a LEFT JOIN b ON a.context = b.context)
SELECT CASE WHEN fewer > 0 AND more > 0 THEN 'other' WHEN fewer > 0 THEN 'narrower' WHEN more > 0 THEN 'wider' ELSE 'same' END AS change, count(*) AS n FROM c GROUP BY 1""",
    "site",
    "dispatch",
    "alloc",
)
def cg_poly_precision(spark, sf_dir):
    big, small = site_graphs(facts(spark, sf_dir, "site", "dispatch", "alloc"))
    return graphs.poly_precision(big, small)


@query(SITES + "SELECT context, count(DISTINCT dst) AS n, count(DISTINCT dst) > 1 AS poly FROM big GROUP BY context", "site", "dispatch", "alloc")
def poly_sites(spark, sf_dir):
    return graphs.site_kinds(site_graphs(facts(spark, sf_dir, "site", "dispatch", "alloc"))[0])


@query(
    "SELECT src, dst FROM call WHERE src NOT IN (SELECT f FROM func WHERE module IN ('Brand#11', 'Brand#23')) AND dst NOT IN (SELECT f FROM func WHERE module IN ('Brand#11', 'Brand#23'))",
    "call",
    "func",
)
def library_filter(spark, sf_dir):
    f = facts(spark, sf_dir, "call", "func")
    packages = f["func"].select("f", F.col("module").alias("package"))
    return graphs.without_packages(f["call"], packages, packages.select("package").where(F.col("package").isin("Brand#11", "Brand#23")).distinct())


@query(
    """e AS (SELECT src AS a, dst AS b FROM call UNION SELECT dst, src FROM call),
r(n, root) USING KEY (n) AS (SELECT f, f FROM func
  UNION (SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.n JOIN recurring.r t ON t.n = e.b GROUP BY e.b, t.root HAVING min(r.root) < t.root))
SELECT n, root FROM r""",
    "call",
    "func",
)
def alias_components(spark, sf_dir):
    f = facts(spark, sf_dir, "call", "func")
    return graphs.components(f["func"].select("f"), f["call"])


@query()
def edge_weights(spark, sf_dir):
    return weights.edge_weights(*split_graphs(facts(spark, sf_dir, "entry", "call")))


@query()
def node_weights(spark, sf_dir):
    return weights.node_weights(*split_graphs(facts(spark, sf_dir, "entry", "call")))


@query("SELECT src, dst, src * 3 % 5 AS weight FROM call", "call")
def edges_by_weight(spark, sf_dir):
    return graphs.by_weight(facts(spark, sf_dir, "call")["call"].withColumn("weight", F.expr("src * 3 % 5")))


@query("SELECT src, dst FROM call WHERE dst = 37 OR src = 37 UNION SELECT f, f FROM func WHERE contains(name, 'green')", "call", "func")
def graph_views(spark, sf_dir):
    f = facts(spark, sf_dir, "call", "func")
    found = graphs.search(f["func"], "green").select(F.col("f").alias("src"), F.col("f").alias("dst"))
    return graphs.in_edges(f["call"], 37).union(graphs.out_edges(f["call"], 37)).union(found).distinct()


# --- call graphs -----------------------------------------------------------------------------

KINDS = "x AS (SELECT *, CASE WHEN kind < 2 THEN 'named' WHEN kind < 5 THEN 'dynamic' ELSE 'value' END AS k FROM site)"


def call_inputs(spark, sf_dir, *more):
    f = facts(spark, sf_dir, "func", "site", "entry", "alloc", "dispatch", *more)
    kind = F.when(F.col("kind") < 2, "named").when(F.col("kind") < 5, "dynamic").otherwise("value")
    f["site"] = stored(f["site"].withColumn("kind", kind))
    f["func"] = stored(f["func"])
    f["index_method"], f["method_class"] = f["dispatch"].select("i", "m").distinct(), f["dispatch"].select("m", "c").distinct()
    return f


TRIVIAL = "triv AS (SELECT DISTINCT s, x.f AS src, target AS dst FROM x JOIN func ON func.f = target WHERE k = 'named')"
MC = "im AS (SELECT DISTINCT i, m FROM dispatch), mc AS (SELECT DISTINCT m, c FROM dispatch)"


@query(f"{KINDS}, {TRIVIAL} SELECT s, src, dst FROM triv WHERE src NOT IN (SELECT f FROM func WHERE is_library)", "func", "site")
def cg_trivial(spark, sf_dir):
    f = call_inputs(spark, sf_dir)
    return callgraph.trivial(f["site"], f["func"], f["func"].where("not is_library").select("f"))


@query(f"{KINDS}, {TRIVIAL}, {MC} SELECT s, src, dst FROM triv UNION SELECT s, f, m FROM x JOIN im ON im.i = x.i WHERE k = 'dynamic'", "func", "site", "dispatch")
def cg_cha(spark, sf_dir):
    f = call_inputs(spark, sf_dir)
    return callgraph.cha(f["site"], f["func"], f["index_method"], f["method_class"])


#: Only what entries allocate counts, so that types prune.
PRTA = f"{KINDS}, {TRIVIAL}, {MC}, made AS (SELECT c FROM alloc WHERE f IN (SELECT f FROM entry)), prta AS (SELECT s, src, dst FROM triv UNION SELECT s, f, m FROM x JOIN im ON im.i = x.i WHERE k = 'dynamic' AND m IN (SELECT m FROM mc JOIN made ON made.c = mc.c))"


def made(f):
    return f["alloc"].join(f["entry"], "f", "left_semi")


@query(f"{PRTA} SELECT * FROM prta", "func", "site", "dispatch", "alloc", "entry")
def cg_prta(spark, sf_dir):
    f = call_inputs(spark, sf_dir)
    return callgraph.prta(f["site"], f["func"], made(f), f["index_method"], f["method_class"])


@query(
    f"""{KINDS}, {MC}, body AS (SELECT f FROM func WHERE NOT is_stub),
cn AS (SELECT DISTINCT x.s, x.f, target AS m FROM x JOIN func ON func.f = target WHERE k = 'named' AND x.f IN (SELECT f FROM body)),
dy AS (SELECT DISTINCT x.s, x.f, im.m, mc.c FROM x JOIN im ON im.i = x.i JOIN mc ON mc.m = im.m WHERE k = 'dynamic' AND x.f IN (SELECT f FROM body)),
nd AS (SELECT DISTINCT f, c, m FROM dy), cf AS (SELECT DISTINCT f, m FROM cn),
r(k, n) USING KEY (k, n) AS (
  SELECT 'f', f FROM entry
  UNION (SELECT * FROM (
    SELECT 'c' AS k, alloc.c AS n FROM r JOIN alloc ON r.k = 'f' AND alloc.f = r.n
    UNION SELECT 'f', cf.m FROM r JOIN cf ON r.k = 'f' AND cf.f = r.n
    UNION SELECT 'f', nd.m FROM r JOIN nd ON r.k = 'f' AND nd.f = r.n JOIN recurring.r t ON t.k = 'c' AND t.n = nd.c
    UNION SELECT 'f', nd.m FROM r JOIN nd ON r.k = 'c' AND nd.c = r.n JOIN recurring.r t ON t.k = 'f' AND t.n = nd.f
  ) z WHERE NOT EXISTS (SELECT 1 FROM recurring.r y WHERE y.k = z.k AND y.n = z.n)))
SELECT s, f AS src, m AS dst FROM cn WHERE f IN (SELECT n FROM r WHERE k = 'f')
UNION SELECT s, f, m FROM dy WHERE f IN (SELECT n FROM r WHERE k = 'f') AND c IN (SELECT n FROM r WHERE k = 'c')""",
    "func",
    "site",
    "entry",
    "dispatch",
    "alloc",
)
def cg_orta(spark, sf_dir):
    f = call_inputs(spark, sf_dir)
    return callgraph.orta(f["site"], f["func"], f["entry"], f["alloc"], f["index_method"], f["method_class"])


@query(
    f"""{PRTA}, o AS (SELECT x.*, func.ret, func.full_type FROM x JOIN func ON func.f = x.i % 40 WHERE k <> 'named' AND x.f NOT IN (SELECT f FROM func WHERE is_library) AND x.s NOT IN (SELECT s FROM prta)),
e AS (SELECT s, o.f AS src, func.f AS dst FROM o JOIN func ON func.full_type = o.full_type)
SELECT s, src, dst FROM e UNION SELECT s, o.f, func.f FROM o JOIN func ON func.nargs = o.nargs AND func.ret = o.ret WHERE s NOT IN (SELECT s FROM e)""",
    "func",
    "site",
    "dispatch",
    "alloc",
    "entry",
)
def cg_sigmatch(spark, sf_dir):
    f = call_inputs(spark, sf_dir)
    edges = callgraph.prta(f["site"], f["func"], made(f), f["index_method"], f["method_class"])
    types = f["func"].select(F.col("f").alias("like"), "ret", "full_type")
    site = f["site"].withColumn("like", F.expr("i % 40")).join(types, "like")
    return callgraph.signature_matches(site, f["func"], edges, f["func"].where("not is_library").select("f"))


FLOWS = "fl AS (SELECT node, what, kind FROM vseed UNION SELECT e.dst, fl.what, fl.kind FROM fl JOIN vedge e ON e.src = fl.node)"


@query(f"{FLOWS} SELECT node, what, kind FROM fl", "vseed", "vedge")
def value_flow(spark, sf_dir):
    f = facts(spark, sf_dir, "vseed", "vedge")
    return callgraph.reaching(f["vseed"], f["vedge"])


VSITE = "v AS (SELECT x.*, x.f * 4 AS recv, x.f * 4 + 1 + x.nargs % 3 AS fnode, func.ret FROM x JOIN func ON func.f = x.i % 40)"


def flow_sites(f):
    types = f["func"].select(F.col("f").alias("like"), "ret")
    return (
        f["site"].withColumn("like", F.expr("i % 40")).join(types, "like").withColumn("recv", F.expr("f * 4")).withColumn("fnode", F.expr("f * 4 + 1 + nargs % 3"))
    )


@query(
    f"""{KINDS}, {TRIVIAL}, {MC}, {FLOWS}, {VSITE}
SELECT s, src, dst FROM triv
UNION SELECT s, v.f, im.m FROM v JOIN im ON im.i = v.i JOIN mc ON mc.m = im.m JOIN fl ON fl.kind = 'class' AND fl.node = v.recv AND fl.what = mc.c WHERE k = 'dynamic'
UNION SELECT s, v.f, fl.what FROM v JOIN fl ON fl.kind = 'func' AND fl.node = v.fnode JOIN func ON func.f = fl.what AND func.nargs = v.nargs AND func.ret = v.ret WHERE k = 'value'""",
    "func",
    "site",
    "dispatch",
    "vseed",
    "vedge",
)
def cg_vta(spark, sf_dir):
    f = call_inputs(spark, sf_dir, "vseed", "vedge")
    flows = stored(callgraph.reaching(f["vseed"], f["vedge"]))
    return callgraph.vta(flow_sites(f), f["func"], flows, f["index_method"], f["method_class"])


BLOCKS = "be AS (SELECT f, b AS src, b + 1 AS dst FROM func, (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2) WHERE f % 2 = 0)"


def blocks_of(func):
    """Every second function has four blocks in a row, the others one block each without order."""
    return func.where("f % 2 = 0").select("f", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("src")).withColumn("dst", F.col("src") + 1)


def ucg_sql(guard: str) -> str:
    return f"""{BLOCKS}, si AS (SELECT s, f, CASE WHEN f % 2 = 0 THEN block ELSE 0 END AS block, i, k, target, f * 4 AS recv FROM x),
al AS (SELECT DISTINCT f, CASE WHEN f % 2 = 0 THEN c % 4 ELSE 0 END AS block, c FROM alloc),
fx AS (SELECT DISTINCT s, target AS m FROM si JOIN func ON func.f = target WHERE k = 'named'),
po AS (SELECT DISTINCT s, si.f, block, mc.c, im.m FROM si JOIN im ON im.i = si.i JOIN mc ON mc.m = im.m {guard} WHERE k = 'dynamic'),
ex AS (SELECT f, CASE WHEN f % 2 = 0 THEN 3 ELSE 0 END AS block FROM func),
r(t, a, b, c) USING KEY (t, a, b, c) AS (
  (SELECT 'o', f, block::BIGINT, c FROM al UNION SELECT 'e', s, m, -1 FROM fx)
  UNION (SELECT * FROM (
    SELECT 'o' AS t, be.f AS a, be.dst::BIGINT AS b, r.c FROM r JOIN be ON r.t = 'o' AND be.f = r.a AND be.src = r.b
    UNION SELECT 'o', e.b, 0, r.c FROM r JOIN si ON r.t = 'o' AND si.f = r.a AND si.block = r.b JOIN recurring.r e ON e.t = 'e' AND e.a = si.s
    UNION SELECT 'o', r.b, 0, o.c FROM r JOIN si ON r.t = 'e' AND si.s = r.a JOIN recurring.r o ON o.t = 'o' AND o.a = si.f AND o.b = si.block
    UNION SELECT 'o', si.f, si.block, r.c FROM r JOIN ex ON r.t = 'o' AND ex.f = r.a AND ex.block = r.b JOIN recurring.r e ON e.t = 'e' AND e.b = r.a JOIN si ON si.s = e.a
    UNION SELECT 'o', si.f, si.block, o.c FROM r JOIN si ON r.t = 'e' AND si.s = r.a JOIN ex ON ex.f = r.b JOIN recurring.r o ON o.t = 'o' AND o.a = ex.f AND o.b = ex.block
    UNION SELECT 'e', po.s, po.m, -1 FROM r JOIN po ON r.t = 'o' AND po.f = r.a AND po.block = r.b AND po.c = r.c
  ) z WHERE NOT EXISTS (SELECT 1 FROM recurring.r y WHERE y.t = z.t AND y.a = z.a AND y.b = z.b AND y.c = z.c)))
SELECT r.a AS s, si.f AS src, r.b AS dst FROM r JOIN si ON r.t = 'e' AND si.s = r.a"""


def ucg_inputs(spark, sf_dir, *more):
    f = call_inputs(spark, sf_dir, *more)
    f["site"] = f["site"].withColumn("block", F.expr("CASE WHEN f % 2 = 0 THEN block ELSE 0 END")).withColumn("recv", F.expr("f * 4"))
    f["alloc"] = f["alloc"].withColumn("block", F.expr("CASE WHEN f % 2 = 0 THEN c % 4 ELSE 0 END"))
    f["exits"] = f["func"].select("f", F.expr("CASE WHEN f % 2 = 0 THEN 3 ELSE 0 END AS block"))
    return f


@query(f"{KINDS}, {MC}, {ucg_sql('')}", "func", "site", "dispatch", "alloc")
def cg_ucg(spark, sf_dir):
    f = ucg_inputs(spark, sf_dir)
    return callgraph.ucg(f["site"], f["func"], f["entry"], f["alloc"], f["index_method"], f["method_class"], blocks_of(f["func"]), exits=f["exits"])


@query(f"{KINDS}, {MC}, {FLOWS}, {ucg_sql(chr(74) + 'OIN fl ON fl.kind = ' + chr(39) + 'class' + chr(39) + ' AND fl.node = si.recv AND fl.what = mc.c')}", "func", "site", "dispatch", "alloc", "vseed", "vedge")
def cg_ucg_vta(spark, sf_dir):
    f = ucg_inputs(spark, sf_dir, "vseed", "vedge")
    flows = stored(callgraph.reaching(f["vseed"], f["vedge"]))
    return callgraph.ucg(f["site"], f["func"], f["entry"], f["alloc"], f["index_method"], f["method_class"], blocks_of(f["func"]), flows=flows, exits=f["exits"])


@query(
    f"""{KINDS}, {TRIVIAL}, {MC}, {FLOWS}, {VSITE},
q(s, src, dst) AS (
  (SELECT s, src, dst FROM triv WHERE src % 10 = 0
   UNION SELECT s, f, m FROM x JOIN im ON im.i = x.i WHERE k = 'dynamic' AND f % 10 = 0 AND m IN (SELECT m FROM mc JOIN alloc ON alloc.c = mc.c)
   UNION SELECT s, v.f, fl.what FROM v JOIN fl ON fl.kind = 'func' AND fl.node = v.fnode WHERE k = 'value' AND v.f IN (SELECT f FROM entry))
  UNION SELECT v.s, v.f, fl.what FROM q JOIN v ON v.f = q.dst AND k = 'value' JOIN fl ON fl.kind = 'func' AND fl.node = v.fnode)
SELECT s, src, dst FROM q""",
    "func",
    "site",
    "dispatch",
    "alloc",
    "vseed",
    "vedge",
    "entry",
)
def cg_queries(spark, sf_dir):
    """Named and dynamic calls of every tenth function; function values are asked for as the graph comes to their functions."""
    f = call_inputs(spark, sf_dir, "vseed", "vedge")
    flows = stored(callgraph.reaching(f["vseed"], f["vedge"]))
    sites = stored(flow_sites(f).where("kind = 'value' or f % 10 = 0"))
    fun = flows.where("kind = 'func'").select(F.col("node").alias("fnode"), F.col("what").alias("dst"))
    entry = stored(f["entry"])

    def resolve(edges):
        live = edges.select(F.col("dst").alias("f")).union(entry).distinct()
        return sites.where("kind = 'value'").join(live, "f", "left_semi").join(fun, "fnode").select("s", F.col("f").alias("src"), "dst")

    return callgraph.by_queries(sites, f["func"], resolve, f["index_method"], f["method_class"], "program", f["alloc"])


@query(
    f"""{PRTA} SELECT count(*) AS sites, count_if(s IN (SELECT s FROM prta)) AS resolved, count_if(s NOT IN (SELECT s FROM prta)) AS unresolved,
count_if(s NOT IN (SELECT s FROM prta) AND k <> 'named') AS truly_unresolved FROM x""",
    "func",
    "site",
    "dispatch",
    "alloc",
    "entry",
)
def callsite_resolution(spark, sf_dir):
    f = call_inputs(spark, sf_dir)
    return callgraph.resolution(f["site"], callgraph.prta(f["site"], f["func"], made(f), f["index_method"], f["method_class"]))


@query(
    """SELECT (SELECT count(*) FROM func) AS methods, (SELECT count(*) FROM func WHERE NOT is_library) AS user_methods,
count(*) AS allocations, count_if(NOT is_library) AS user_allocations FROM alloc JOIN func ON func.f = alloc.f""",
    "func",
    "alloc",
)
def cg_stats(spark, sf_dir):
    f = facts(spark, sf_dir, "func", "alloc")
    return callgraph.method_stats(f["func"], f["alloc"])
