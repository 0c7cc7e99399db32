"""Checking results against annotations in source comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The mark that separates an annotation's fields, by family.
FAMILIES = {"!": "taint", "?": "typestate", "$": "crypto"}


def read(lines: DataFrame) -> DataFrame:
    """path, line, family, name, kind, status of the annotations in (path, line, text) rows.

    `//!name!kind[!status]`, and likewise with ? and $. A taint annotation on a line that is a comment
    as a whole doesn't count.
    """
    each = lines.select("path", "line", "text", F.explode(F.split("text", "//")).alias("part"))
    mark = F.substring("part", 1, 1)
    fields = F.split(F.trim("part"), r"[!?$]")
    out = each.where(mark.isin(list(FAMILIES))).select("path", "line", "text", mark.alias("mark"), F.trim("part").alias("part"), fields.alias("x"))
    out = out.where((F.size("x") >= 3) & ~((F.col("mark") == "!") & F.col("text").startswith("//")))
    family = F.create_map(*[F.lit(v) for k in FAMILIES.items() for v in k])
    get = lambda i: F.trim(F.try_element_at("x", F.lit(i)))
    return out.select("path", "line", family[F.col("mark")].alias("family"), get(2).alias("name"), get(3).alias("kind"), F.when(get(4) != "", get(4)).alias("status"))


def checked(result: DataFrame, note: DataFrame) -> DataFrame:
    """path, line, name, kind, verdict: each result uses up one annotation of its line, name and kind.

    result(path, line, name, kind); note the same with status. Verdicts: ok; unexpected; missed; known
    miss (`fn` left over); found after all (`fn` used); ignored: a result on a line that has annotations
    of other names or kinds only.
    """
    key = ["path", "line", "name", "kind"]
    by = Window.partitionBy(*key)
    a = result.select(*key).withColumn("k", F.row_number().over(by.orderBy(F.lit(0)))).withColumn("r", F.lit(True))
    b = note.select(*key, "status").withColumn("k", F.row_number().over(by.orderBy(F.col("status").asc_nulls_first()))).withColumn("n", F.lit(True))
    j = a.join(b, [*key, "k"], "full_outer")
    lines = note.select("path", "line").distinct().withColumn("noted", F.lit(True))
    same = note.select(*key).distinct().withColumn("same", F.lit(True))
    j = j.join(lines, ["path", "line"], "left").join(same, key, "left")
    alone = F.col("n").isNull()
    verdict = (
        F.when(alone & (F.col("noted").isNull() | F.col("same").isNotNull()), "unexpected")
        .when(alone, "ignored")
        .when(F.col("r").isNull() & (F.col("status") == "fn"), "known miss")
        .when(F.col("r").isNull(), "missed")
        .when(F.col("status") == "fn", "found after all")
        .otherwise("ok")
    )
    return j.select(*key, verdict.alias("verdict"))


def failures(checked_: DataFrame) -> DataFrame:
    """What makes a test fail, in order."""
    return checked_.where("verdict in ('unexpected', 'missed', 'found after all')").orderBy("path", "line", "name", "kind", "verdict")
