"""Mixing sources to target weights.

Every row gets a hash-random key of its id and text, so that rows without or with one id are
spread over all keys as well. Rows are dealt to ranges of that key within their source
(the key is uniform, so equal ranges are even parts, however hot a source is), each range is
sorted, and prefix sums of word counts run first over ranges, then within them. A source's
budget is cut exactly where the running sum reaches it; a budget above the source's size runs
over into further epochs in the same order.

Defined results: null text has no words; null is a source of its own, after all others;
repeated rows are taken one by one; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, text_or_empty, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The mix as a share of all words, and the most that one source may give as a share of its own.
TOTAL_SHARE, MOST_EPOCHS = 1.5, 2


def random_key(seed: str):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_or_empty())))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words and random key of every row."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        random_key(seed).alias("key"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: shares by weight, what lies above a source's cap goes to the others.

    Giving the excess to the others by weight until none is above its cap ends where every
    source has the lesser of its cap and a common level times its weight; the level is found by
    going through the sources in the order in which they reach their caps. The table has one
    row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1)
    filled = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("i", F.row_number().over(by_name))
        .withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("at", F.col("cap") / F.col("w"))
        .withColumn("words", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("gone_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("words") - F.col("capped")) / (F.col("all_w") - F.col("gone_w")))
        .withColumn("held", F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(every))
        .select("source", "source_size", F.least("cap", F.coalesce("held", F.col("at")) * F.col("w")).alias("target"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, key, begins and budget of every row."""
    spark = docs.sparkSession
    ranges = max(256, 4 * partitions(spark))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(2**32)).cast("int")
    rows = (
        written(sized(docs, seed), "sized")
        .withColumn("part", part)
        .withColumn("none", F.col("source").isNull())
        .withColumn("src", F.coalesce("source", F.lit("")))
    )
    group = ["none", "src"]
    parts = rows.groupBy(*group, "part").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    parts = written(parts, "ranges")
    sizes = parts.groupBy(*group).agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    goal = targets(sizes, weights, share, most).select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), "source_size", "target"
    )
    # a row for each range of each source
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(goal, group)
    inside = Window.partitionBy(*group, "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.round("target").cast("long")
    rest = F.when(F.col("source_size") > 0, F.col("budget") - F.floor(F.col("budget") / F.col("source_size")).cast("long") * F.col("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size")).cast("long")).otherwise(0)
    return (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(parts.select(*group, "part", "base", "source_size", "target"), [*group, "part"])
        .withColumn("begins", F.col("base") + F.col("upto") - F.col("size"))
        .withColumn("budget", budget)
        .withColumn("epochs", whole)
        .withColumn("rest", F.coalesce(rest, F.lit(0)))
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begins"))))
        .select(
            "doc_id",
            "size",
            F.col("source_size").cast("long").alias("source_size"),
            "target",
            (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"),
            "source",
            "key",
            "begins",
            "epochs",
            F.col("last").cast("long").alias("last"),
        )
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their columns, once for each epoch that takes any of them.

    All rows up to a source's cut, in the order of its random keys, are taken in its last epoch, so
    what a row needs to know is its source's number of whole epochs and the key at the cut.
    """
    rows = mix(docs, **options)
    cuts = rows.groupBy("source").agg(
        F.max("epochs").alias("epochs"), F.max(F.when(F.col("last") > 0, F.struct("key", "doc_id"))).alias("cut")
    )
    cuts = written(cuts, "cuts").select(F.col("source").alias("cut_source"), "epochs", "cut")
    columns = docs.columns
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], "doc_id", "source", random_key(options.get("seed", "mix-1")).alias("key"))
    last = F.coalesce((F.struct("key", "doc_id") <= F.col("cut")).cast("int"), F.lit(0))
    kept = kept.join(cuts, F.col("source").eqNullSafe(F.col("cut_source"))).withColumn("copies", F.col("epochs") + last)
    kept = kept.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
