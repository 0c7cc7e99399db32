"""Unification-based alias analysis: classes of values that assignments and equal fields of equal objects join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import counted, stored
from .graphs import components


def alias_classes(value: DataFrame, copy: DataFrame, access: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """n, root: value(n), copy(src, dst), access(obj, field, n) for n = obj.field and obj.field = n.

    Classes are joined by copies; then values of one field of objects in one class are joined, too,
    until no field joins more. Only classes that are still to be joined are followed again, by their roots.
    """
    label = stored(components(value.toDF("n").union(access.select("n")), copy.select("src", "dst")))
    for _ in range(max_rounds):
        held = access.join(label.toDF("obj", "of"), "obj").join(label, "n").select("of", "field", "root").distinct()
        held = stored(held)
        first = held.groupBy("of", "field").agg(F.min("root").alias("src"))
        same, n = counted(held.join(first, ["of", "field"]).where("src <> root").select("src", F.col("root").alias("dst")).distinct())
        if not n:
            return label
        joined = components(same.select("src"), same).toDF("root", "to")
        label = stored(label.join(joined, "root", "left").select("n", F.coalesce("to", "root").alias("root")))
    raise RuntimeError(f"classes still join after {max_rounds} rounds")


def allocation_classes(label: DataFrame, alloc: DataFrame) -> DataFrame:
    """root, allocs: the allocations of each class that has any; alloc(n, c)."""
    return label.join(alloc, "n").groupBy("root").agg(F.array_sort(F.collect_set("c")).alias("allocs"))


def type_bits(alloc: DataFrame) -> DataFrame:
    """f, bucket, bits: the classes that each function allocates, as bitmaps; c is a dense number from 1."""
    return alloc.groupBy("f", F.bitmap_bucket_number("c").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))


def joined_bits(bits: DataFrame, by: str) -> DataFrame:
    """The union of bitmaps by a column, with its number of classes."""
    return bits.groupBy(by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))
