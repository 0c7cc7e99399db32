"""Results as JSON documents, graphs as text, and figures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import position_text


def taint_json(paths: DataFrame, spec: DataFrame, func_of_site: DataFrame) -> DataFrame:
    """name, json: a document for each rule with results; spec has the rules' about and advice; func_of_site(s, method, description) describes sites' targets."""
    about = spec.groupBy("name").agg(F.first("about").alias("description"), F.first("advice").alias("advice"))
    src = func_of_site.select(F.col("s").alias("source"), F.struct(F.col("method").alias("name"), "description").alias("source_m"))
    snk = func_of_site.select(F.col("s").alias("sink"), F.struct(F.col("method").alias("name"), "description").alias("sink_m"))
    rows = paths.join(src, "source", "left").join(snk, "sink", "left")
    one = F.struct(F.col("source_m").alias("source"), F.col("sink_m").alias("sink"), F.transform("path", position_text).alias("path"))
    out = rows.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("paths")).join(about, "name")
    return out.select("name", F.to_json(F.struct("name", "description", "advice", "paths")).alias("json"))


def typestate_json(errors: DataFrame, machine: DataFrame) -> DataFrame:
    """name, json: a document for each machine; errors(name, pos, message, severity, state)."""
    one = F.struct(position_text(F.col("pos")).alias("pos"), "message", "severity", "state")
    found = errors.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("errors"))
    rows = machine.select("name", "description", "advice").join(found, "name")
    return rows.select("name", F.to_json(F.struct("name", "description", "advice", "errors")).alias("json"))


def crypto_json(results: DataFrame) -> DataFrame:
    """json: one document of (name, message, pos); a result without position has the location `none`."""
    rows = results.select("name", "message", F.when(F.col("pos").isNull(), "none").otherwise(position_text(F.col("pos"))).alias("location")).distinct()
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "message", "location")))).alias("json"))


def stats_json(*figures: DataFrame, **times: float) -> DataFrame:
    """json: one document of the columns of one-row tables, and times in seconds."""
    one = figures[0]
    for f in figures[1:]:
        one = one.crossJoin(f)  # one row each
    return one.withColumns({k: F.lit(v) for k, v in times.items()}).select(F.to_json(F.struct("*")).alias("json"))


def dot(edge: DataFrame) -> DataFrame:
    """value: lines of a graph in the DOT language."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    spark = edge.sparkSession
    body = edge.select("src", "dst").distinct().orderBy("src", "dst").select(F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("value"))
    ends = lambda s: spark.range(1).select(F.lit(s).alias("value"))
    return ends("digraph G {").unionByName(body).unionByName(ends("}"))


def function_names(function: DataFrame) -> DataFrame:
    return function.select("func").orderBy("func")


def missing_models(function: DataFrame) -> DataFrame:
    """Functions that only stubs stand for."""
    return function.where("attribute = 'stub'").select("func").orderBy("func")


def line_map(stmt: DataFrame) -> DataFrame:
    """path, line, stmt_id: source lines and the statements that come of them."""
    return stmt.where("pos_path is not null").select(F.col("pos_path").alias("path"), F.col("pos_line").alias("line"), "stmt_id")


def query_times(metric: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """One row: number, total and mean of query times, and how many were slow; metric(ms)."""
    return metric.agg(F.count(F.lit(1)).alias("queries"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("average_ms"), F.count_if(F.col("ms") > slow_ms).alias("anomalies"))
