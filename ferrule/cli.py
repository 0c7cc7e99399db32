"""Command line: read a program, build its call graph, run analyses, write results."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import callgraph, graphs, merge, reports
from .plans.program import ALGORITHMS, Program
from .plans.store import stored
from .sources import ir_text, probe, sil, specs


@dataclass
class Options:
    """What a run does; hooks get the tables after each stage."""

    path: str
    out: str
    algorithm: str = "ucg_no_vta"
    taint: str | None = None
    typestate: str | None = None
    crypto: bool = False
    libraries: bool = False
    closures: bool = False
    prune: bool = True
    sanitize: bool = False
    track: bool = False
    modules: list[str] = field(default_factory=list)
    dot: bool = False
    probe: bool = False
    names: bool = False
    call_graph_only: bool = False
    hooks: dict[str, Callable] = field(default_factory=dict)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ferrule", description=__doc__)
    p.add_argument("path", help="folder of programs: .sil files, and textual functions in .ir files")
    p.add_argument("-o", "--out", default="ferrule-out", help="folder of results")
    p.add_argument("--cg-algo", dest="algorithm", choices=ALGORITHMS, default="ucg_no_vta")
    p.add_argument("-t", "--taint", help="taint specification (JSON)")
    p.add_argument("-e", "--typestate", help="typestate specification (JSON)")
    p.add_argument("--crypto", action="store_true", help="check the use of cryptography")
    p.add_argument("-l", "--libraries", action="store_true", help="library functions are entries, too")
    p.add_argument("-u", "--closures", action="store_true", help="closures are entries, too")
    p.add_argument("--no-prune", dest="prune", action="store_false", help="keep entries that have callers")
    p.add_argument("-s", "--sanitize", action="store_true", help="sanitizers stop taint")
    p.add_argument("-p", "--paths", dest="track", action="store_true", help="report the statements of a path for each flow of taint, if it enters no sanitizer")
    p.add_argument("-m", "--module", dest="modules", action="append", default=[], help="pattern of analysed modules; others are libraries")
    p.add_argument("-d", "--dot", action="store_true")
    p.add_argument("--probe", action="store_true", help="write the call graph in comparison format")
    p.add_argument("-n", "--names", action="store_true", help="write function names, and those that only stubs stand for")
    p.add_argument("-g", "--call-graph-only", action="store_true")
    return p


def load(spark: SparkSession, options: Options) -> Program:
    """The functions of all modules of a folder, merged; a model among the textual ones, which come after the compiled, takes the place of a stub."""
    parts, tables = [], None
    compiled = sil.texts(spark, options.path)
    if compiled.inputFiles():
        rows, tables = sil.split(compiled)
        parts.append(rows.withColumn("kind", F.lit(merge.KINDS.index("compiled"))))
    written = ir_text.read(spark, options.path, "*.ir")
    if written.inputFiles():
        parts.append(written.withColumn("kind", F.lit(merge.KINDS.index("written"))))
    if not parts:
        raise FileNotFoundError(f"no .sil or .ir files in {options.path}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if "functions" in options.hooks:
        rows = options.hooks["functions"](rows)
    return Program(rows, tables, options.modules)


def run(spark: SparkSession, options: Options) -> dict[str, DataFrame]:
    """Do what the options ask for and write it; the tables are returned, too."""
    program = load(spark, options)
    edge = stored(program.call_graph(options.algorithm, options.closures, options.libraries))
    entry = program.entries(options.closures, options.libraries)
    if options.prune:
        entry = graphs.prune_entries(entry, edge)
    out = {"call_edge": edge, "entry": stored(entry)}
    figures = callgraph.resolution(program.sites().select("s", "kind").distinct(), edge)
    out["stats"] = reports.stats_json(figures)
    if options.dot:
        out["dot"] = reports.dot(edge)
    if options.probe:
        out["probe"] = probe.text(program.func, out["entry"].select(F.col("f").alias("name")), edge.select("src", "dst", F.lit(None).cast("double").alias("weight"), F.col("s").alias("context")))
    if options.names:
        out["names"], out["missing"] = reports.function_names(program.facts["function"]), reports.missing_models(program.facts["function"])
    if options.taint and not options.call_graph_only:
        spec = specs.taint(spark, options.taint)
        paths = stored(program.taint(spec, edge, options.sanitize, options.track))
        sites = edge.join(spec.select(F.col("method").alias("dst"), "description"), "dst").select("s", F.col("dst").alias("method"), "description").distinct()
        out["taint"] = reports.taint_json(paths, spec, sites)
    if options.typestate and not options.call_graph_only:
        machines = specs.typestate(spark, options.typestate)
        out["typestate"] = reports.typestate_json(stored(program.typestate(machines, edge)), machines["machine"])
    if options.crypto and not options.call_graph_only:
        out["crypto"] = reports.crypto_json(stored(program.crypto(edge, options.libraries)))
    for name, df in out.items():
        target = f"{options.out}/{name}"
        if df.columns == ["value"]:
            df.coalesce(1).write.mode("overwrite").text(target)  # ordered lines of one file
        elif "json" in df.columns:
            df.select("json").write.mode("overwrite").text(target)
        else:
            df.write.mode("overwrite").parquet(target)
    return out


def main(argv: list[str] | None = None) -> None:
    options = Options(**vars(parser().parse_args(argv)))
    spark = SparkSession.builder.appName("ferrule").getOrCreate()
    out = run(spark, options)
    print(json.dumps({name: df.count() for name, df in out.items()}))


if __name__ == "__main__":
    main()
