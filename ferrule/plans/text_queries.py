"""Readers and writers as queries: program texts made of the test tables, read back to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotations, reports
from ..sources import ir_model, ir_text, probe, sil
from ..sources.projection import facts, with_facts
from .store import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *names: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"WITH {with_facts(*names)} {sql}"
        return function

    return add


def bodies(spark, sf_dir) -> DataFrame:
    """module, f, callees: the projected calls by caller, a module for each brand."""
    f = facts(spark, sf_dir, "func", "call")
    calls = f["call"].groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    return f["func"].select("f", "module").join(calls, F.col("f") == F.col("src"), "left").select("module", "f", F.coalesce("callees", F.array().cast("array<bigint>")).alias("callees"))


#: Numbers of functions that one file of a module spans: files are many where functions are, not long.
SPAN = 5000


def module_texts(lines: DataFrame, head: str) -> DataFrame:
    """module, text of (module, f, text) rows, a module in any number of files."""
    whole = lines.groupBy("module", F.floor(F.col("f") / SPAN).alias("part")).agg(F.array_sort(F.collect_list(F.struct("f", "text"))).alias("t"))
    return whole.select("module", F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("text"))


def ir_texts(spark, sf_dir) -> DataFrame:
    b = bodies(spark, sf_dir)
    call = lambda x, i: F.format_string("  r%s = function_ref @`f%s`, $`Any`\n  x%s = apply r%s(), $`Int` : \"m\":%s:1", i, x, i, i, i + 1)
    text = F.concat(
        F.format_string("func @`f%s` : $`Int` {\nbb0:\n", "f"), F.array_join(F.transform("callees", call), "\n"), F.lit("\n  v = new $`Int`\n  return v\n}\n")
    )
    return module_texts(b.select("module", "f", text.alias("text")), "ir_stage raw\n\n")


def sil_texts(spark, sf_dir) -> DataFrame:
    b = bodies(spark, sf_dir)
    kind = "$@convention(thin) () -> Int"
    call = lambda x, i: F.format_string(f"  %%%s = function_ref @f%s : {kind} // user\n  %%%s = apply %%%s() : {kind}, loc \"m\":%s:1, scope 1", 2 * i, x, 2 * i + 1, 2 * i, i + 1)
    n = 2 * F.size("callees")
    end = F.format_string("\n  %%%s = tuple ()\n  return %%%s : $()\n} // end\n", n, n)
    text = F.concat(F.format_string(f"sil hidden @f%s : {kind} {{\nbb0:\n", "f"), F.array_join(F.transform("callees", call), "\n"), end)
    return module_texts(b.select("module", "f", text.alias("text")), "sil_stage canonical\n\n")


def parsed_calls(functions: DataFrame) -> DataFrame:
    """src, dst, line: calls in the facts of parsed functions."""
    f = ir_model.facts_of(stored(functions))
    refs = f["stmt"].where("kind = 'function_ref'").select("func", F.col("result").alias("callee_sym"), F.col("fn_name").alias("callee"))
    calls = f["stmt"].where("kind = 'apply'").join(refs, ["func", "callee_sym"])
    num = lambda c: F.expr(f"cast(substring({c}, 2) as bigint)")
    return calls.select(num("func").alias("src"), num("callee").alias("dst"), F.col("pos_line").alias("line"))


CALLS = "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS line FROM call WHERE src IN (SELECT f FROM func)"


@query(CALLS, "call", "func")
def ir_parse(spark, sf_dir):
    return parsed_calls(ir_text.functions(ir_texts(spark, sf_dir)))


@query(CALLS, "call", "func")
def ir_print_parse(spark, sf_dir):
    raw = ir_text.functions(ir_texts(spark, sf_dir), lowered=False)
    return parsed_calls(ir_text.functions(ir_text.printed(raw)))


@query(CALLS, "call", "func")
def sil_parse(spark, sf_dir):
    return parsed_calls(ir_text.functions(sil_texts(spark, sf_dir), parser=sil.each))


@query(
    """SELECT 'vtable_entry' AS what, concat('c', c) AS a, concat('#c', c % 5, '.v', i) AS b, concat('m', m) AS d, concat('c', c % 5) AS e FROM dispatch
UNION SELECT 'witness_entry', concat('c', c), concat('p', c % 7), concat('#p', c % 7, '.i', i), concat('m', m) FROM dispatch
UNION SELECT 'witness', concat('c', c), concat('p', c % 7), NULL, NULL FROM dispatch UNION SELECT 'base', concat('c', c), concat('q', c % 3), NULL, NULL FROM dispatch
UNION SELECT 'global', concat('g', c), 'Int', NULL, NULL FROM dispatch UNION SELECT 'function', concat('h', c), 'Int', NULL, NULL FROM dispatch""",
    "dispatch",
)
def sil_tables(spark, sf_dir):
    """Dispatch tables, globals and functions of compiled modules, one for each class, from a single parse of their texts."""
    d = facts(spark, sf_dir, "dispatch")["dispatch"].select("c", "i", "m").distinct()
    slot = d.select("c", F.format_string("  #c%s.v%s: @m%s", F.col("c") % 5, "i", "m").alias("v"), F.format_string("  method #p%s.i%s: @m%s", F.col("c") % 7, "i", "m").alias("w"))
    lines = slot.groupBy("c").agg(F.array_join(F.collect_list("v"), "\n").alias("v"), F.array_join(F.collect_list("w"), "\n").alias("w"))
    text = F.format_string(
        "sil_stage canonical\n\nsil_global hidden @g%s : $Int\n\nsil @h%s : $@convention(thin) () -> Int\n\nsil_vtable c%s {\n%s\n}\n\nsil_witness_table hidden c%s: p%s module app {\n  base_protocol q%s: c%s: q module app\n%s\n}\n",
        "c", "c", "c", "v", "c", F.col("c") % 7, F.col("c") % 3, "c", "w",
    )
    functions, tables = sil.split(lines.select(F.format_string("m%s.sil", "c").alias("module"), text.alias("text")))
    rows = [df.drop("module").toDF(*"abde"[: len(df.columns) - 1]).withColumn("what", F.lit(name)) for name, df in tables.items()]
    rows.append(functions.where("func rlike '^h[0-9]+$'").select(F.lit("function").alias("what"), F.col("func").alias("a"), F.col("return_type").alias("b")))
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select("what", "a", "b", "d", "e")


@query("SELECT 'f' || src AS src, 'f' || dst AS dst FROM call", "call")
def probe_roundtrip(spark, sf_dir):
    f = facts(spark, sf_dir, "call", "func", "entry")
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("name")
    edge = f["call"].select(F.concat(F.lit("f"), "src").alias("src"), F.concat(F.lit("f"), "dst").alias("dst"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("context"))
    text = probe.text(f["func"].select(name("f")), f["entry"].select(name("f")), edge)
    lines = text.withColumn("r", F.monotonically_increasing_id()).select(F.lit("one").alias("file"), "r", F.posexplode(F.split("value", "\n")).alias("k", "value"))
    # a record's lines stay together, and records are told apart by their number
    records = lines.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("l"))
    rows = records.select(F.lit("one").alias("file"), F.col("l")[0]["value"].alias("tag"), F.transform(F.slice("l", 2, 4), lambda x: x["value"]).alias("x"))
    got = probe.tables(rows)
    names = got["method"].select("id", "name")
    return got["edge"].join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query("SELECT 'p' || CAST(module AS STRING) AS path, f AS line, 'taint' AS family, 'rule' AS name, CASE WHEN size % 2 = 0 THEN 'sink' ELSE 'source' END AS kind, CASE WHEN size % 3 = 0 THEN 'fn' END AS status FROM func", "func")
def annotation_read(spark, sf_dir):
    f = facts(spark, sf_dir, "func")["func"]
    text = F.concat(F.lit("x = y //!rule!"), F.when(F.col("size") % 2 == 0, "sink").otherwise("source"), F.when(F.col("size") % 3 == 0, "!fn").otherwise(""), F.lit(" // done"))
    return annotations.read(f.select(F.concat(F.lit("p"), "module").alias("path"), F.col("f").alias("line"), text.alias("text")))


@query("SELECT value FROM (SELECT DISTINCT '  \"' || src || '\" -> \"' || dst || '\";' AS value FROM call UNION ALL SELECT 'digraph G {' UNION ALL SELECT '}')", "call")
def call_graph_dot(spark, sf_dir):
    return reports.dot(facts(spark, sf_dir, "call")["call"])
