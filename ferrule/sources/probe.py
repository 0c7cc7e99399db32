"""Call graphs in the text format of comparison tools: one field a line, a tag before each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tags and the number of lines after them.
RECORDS = {"CLASS": 3, "METHOD": 4, "ENTRYPOINT": 1, "CALLEDGE": 4}


def records(lines: DataFrame) -> DataFrame:
    """tag, fields: records of (pos, value) lines; pos orders the lines of a file.

    A tag only counts where the fields of the record before it have ended, but since fields that read
    like tags do not occur in these files, each tag starts a record.
    """
    tag = F.col("value").isin(list(RECORDS))
    at = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    group = lines.withColumn("n", F.sum(tag.cast("int")).over(at)).where("n > 0")
    rows = group.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("r"))
    values = F.transform("r", lambda x: x["value"])
    return rows.select("file", F.element_at(values, 1).alias("tag"), F.slice(values, 2, 4).alias("x"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """class, method, entry(f), edge(src, dst, weight, context) of files, plain or gzipped."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return tables(records(lines))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    x = lambda i: F.try_element_at("x", F.lit(i))
    return {
        "class": rows.where("tag = 'CLASS'").select(x(1).alias("id"), x(2).alias("package"), x(3).alias("name")),
        "method": rows.where("tag = 'METHOD'").select(x(1).alias("id"), x(2).alias("name"), x(3).alias("signature"), x(4).alias("class")),
        "entry": rows.where("tag = 'ENTRYPOINT'").select(x(1).alias("f")),
        "edge": rows.where("tag = 'CALLEDGE'").select(
            x(1).alias("src"), x(2).alias("dst"), F.coalesce(F.expr("try_cast(x[2] as double)"), F.lit(1.0)).alias("weight"), F.when(x(4) != "", x(4)).alias("context")
        ),
    }


def text(func: DataFrame, entry: DataFrame, edge: DataFrame) -> DataFrame:
    """value: the lines of a graph, its methods by name, one class for all; context is `line:col` or empty."""
    ident = lambda c: F.hex(F.xxhash64(c))
    none = F.lit("")
    one = func.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("").alias("k"), F.array(F.lit("CLASS"), F.lit("0"), none, F.lit("program")).alias("l"))
    m = func.select(F.lit(1).alias("o"), F.col("name").alias("k"), F.array(F.lit("METHOD"), ident("name"), F.col("name"), none, F.lit("0")).alias("l"))
    e = entry.select(F.lit(2).alias("o"), F.col("name").alias("k"), F.array(F.lit("ENTRYPOINT"), ident("name")).alias("l"))
    weight = F.coalesce(F.col("weight").cast("string"), F.lit("0.0"))
    c = edge.select(F.lit(3).alias("o"), F.concat_ws(" ", "src", "dst", "context").alias("k"), F.array(F.lit("CALLEDGE"), ident("src"), ident("dst"), weight, F.coalesce("context", none)).alias("l"))
    rows = one.unionByName(m).unionByName(e).unionByName(c).orderBy("o", "k")
    return rows.select(F.array_join("l", "\n").alias("value"))


def polymorphic(edge: DataFrame) -> DataFrame:
    """context, n of sites with several targets."""
    return edge.where("context is not null").groupBy("context").agg(F.count_distinct("dst").alias("n")).where("n > 1")
