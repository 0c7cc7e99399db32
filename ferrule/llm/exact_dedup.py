"""Exact dedup by tree-merging sorted runs of digests.

Every row belongs to one of P runs, P a power of FAN at least the number of shuffle
partitions. A run holds one entry per digest: the row that stays, and how many rows share
the digest. In round r the runs whose numbers differ in digit r only exchange entries: each
keeps the digests whose own digit r equals its new number's, so after log(P) rounds run i
holds all entries of the i-th part of the digest space. This is the binomial exchange in the
form that halves what each partition keeps, so no partition ever holds more than its share,
and a digest shared by a third of all rows is one entry a run, never a hot group. Each round
merges the FAN sorted runs that meet, keeping the best row of each digest.

A digest is verified at each level by two more facts of the text, its normalised length and
an independent 64-bit hash; entries merge only when all three agree.

Defined results: null text is the empty text; empty texts equal each other; among rows equal
in every respect one arbitrary row stays; null doc_id sorts after all others; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE, partitions, power_at_least, row_check, row_key, text_or_empty, written

#: Runs that meet in one merge.
FAN = 4


def digests(docs: DataFrame) -> DataFrame:
    """Row number, length, digest and check facts of every row."""
    norm = F.regexp_replace(text_or_empty(), f"[{SPACE}]+", "")
    return (
        docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("n_cp"), norm.alias("norm"), row_key().alias("row_key"), row_check().alias("row_check"))
        .select(
            "doc_id",
            "n_cp",
            F.sha2(F.col("norm").cast("binary"), 256).alias("digest"),
            F.octet_length("norm").cast("long").alias("norm_len"),
            F.xxhash64("norm").alias("check"),
            *ROW,
        )
        .withColumn("rid", F.monotonically_increasing_id())
    )


KEY = ["digest", "norm_len", "check"]


def _digit(col, r: int):
    return F.pmod(F.floor(col / F.lit(FAN**r)), F.lit(FAN)).cast("long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, rid, row_key and row_check, a row for each row of docs."""
    spark = docs.sparkSession
    runs = power_at_least(partitions(spark), FAN)
    rows = written(digests(docs), "digests").withColumn("run", F.pmod(F.xxhash64("rid"), F.lit(runs)))
    # the order in which rows of one text stay: most code points, smallest id, nulls last
    best = F.struct(
        (-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"
    )
    first = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    first = written(first, "runs")
    # the part of the digest space, by the verified hash: as uniform as the digest
    part = F.pmod(F.col("check"), F.lit(runs))
    level, r = first.withColumn("at", F.col("run")), 0
    while FAN**r < runs:
        moved = level.withColumn("at", (F.col("at") + (_digit(part, r) - _digit(F.col("at"), r)) * F.lit(FAN**r)).cast("int"))
        # a run is the partition of its number: none holds two runs while another is empty
        level = (
            moved.repartitionById(runs, F.col("at"))
            .groupBy("at", *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
        r += 1
    # down again: every run's entry learns the winner, then every row learns its run's
    told = first.select("run", *KEY).join(level.select(*KEY, "best", "n"), KEY)
    return rows.join(told, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("best.rid") == F.col("rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "rid",
        *ROW,
    )
