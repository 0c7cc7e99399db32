"""Merkle manifest of a table, with proofs by coordinate lookup.

Every row is a leaf: the SHA-256 of its fields, each with its length. Leaves of one group (a
language) stand in the order of their ids and are hashed in runs of FAN until one node, the
group's subroot, remains; subroots are the leaves of one more tree, whose top is the root.

Places in a group are found without a global sort in one task: the (group, id) order is cut
into ranges, each is sorted, and prefix sums over the ranges' counts give every row its place.
All nodes are written as a table of (group, level, index). A proof then needs no walk: from a
leaf's place and its group's size follow the coordinates of its siblings on every level. The
leaves of one lowest run need the same coordinates, so a run explodes them once; they are
joined with the node table, ordered, concatenated and folded.

A node of level l is asked for by 8^(l-1) runs of each sibling: it is stored under 8^(l-2)
numbers and each run asks for one of them, so no key of the join is hot, and the copies are a
64th of the leaves a level. Siblings among subroots are joined by group and range, not by group.

Defined results: a null field is `-`; null groups are one group, before all others; null ids
come first in their group; rows of one id stand in the order of their leaves; repeated rows are
leaves each; a group of one row has its leaf as subroot, one group's subroot is the root; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Nodes of a run.
FAN = 8
#: FAN to the power of 0, 1, ...: widths of the nodes of each level, in leaves.
POWERS = [FAN**k for k in range(21)]
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, by which no two rows of fields read the same."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields=FIELDS, **changed: Column) -> Column:
    """The digest of a row's fields; changed: other values for some of them."""
    return digest(*[field(changed.get(c, F.col(c))) for c in fields])


def power(level: Column) -> Column:
    """FAN to the power of level."""
    return F.element_at(F.array(*[F.lit(p).cast("long") for p in POWERS]), (level + 1).cast("int"))


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in POWERS]), lambda p: p < n))


def placed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows(g, ord, digest, ...) with part, pos and n, and a table of (g, part, base, n).

    pos is the place in the group g, in the order of ord and digest; n is the group's size.
    """
    order = ["g", F.col("ord").asc_nulls_first(), "digest", "tie"]
    # rows equal in all of these are equal leaves, whose order is free; the number spreads them over ranges
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("tie")
    # within a partition these numbers rise by one, in its order
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    each = Window.partitionBy("g")
    before = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of each group
    parts = counts.select("g", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(each).alias("n"))
    parts = written(parts, f"{name}-parts")
    here = ranged.join(parts, ["g", "part"]).withColumn("pos", F.col("base") + F.col("at") - F.col("first"))
    return here.drop("at", "first", "base"), parts


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def tree(rows: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """g, level, idx, digest, n: all nodes over rows(g, pos, n, digest), each level written."""
    level = rows.select("g", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest", "n")
    nodes, most = level, parts.agg(F.max("n")).first()[0] or 0
    for k, width in enumerate(POWERS):
        if width >= most:
            break
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        level = (
            level.where(F.col("n") > width)
            .groupBy("g", F.floor(F.col("idx") / FAN).alias("idx"))
            .agg(run.alias("run"), F.first("n").alias("n"))
            .select("g", F.lit(k + 1).alias("level"), "idx", digest(joined(F.col("run.digest"))).alias("digest"), "n")
        )
        level = written(level, f"{name}-{k + 1}")
        nodes = nodes.unionByName(level)
    return nodes


def tops(nodes: DataFrame) -> DataFrame:
    """g, digest: the node that remains of each group."""
    return nodes.where(F.col("level") == height(F.col("n"))).select("g", "digest")


def requested(rows: DataFrame) -> DataFrame:
    """g, run, level, idx: the coordinates that proofs need, for each lowest run of rows(g, pos, n)."""
    run = rows.where((F.col("pos") % FAN == 0) & (F.col("n") > 1)).select("g", F.floor(F.col("pos") / FAN).alias("run"), "n", height(F.col("n")).alias("height"))
    levels = run.select("g", "run", "n", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
    # the node of this level that holds the run; on the lowest level, all of the run's leaves are wanted
    levels = levels.withColumn("own", F.when(F.col("level") > 0, F.floor(F.col("run") / power(F.col("level") - 1))))
    first = F.when(F.col("level") == 0, F.col("run") * FAN).otherwise(F.floor(F.col("own") / FAN) * FAN)
    width = F.ceil(F.col("n") / power(F.col("level")))
    wanted = levels.select("g", "run", "level", "own", F.explode(F.sequence(first, F.least(first + (FAN - 1), width - 1))).alias("idx"))
    return wanted.where("own is null or idx <> own").drop("own")


def proven(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows(g, pos, n, ...) with steps: for each level the digests to the left and to the right."""
    copies = F.when(F.col("level") > 2, power(F.col("level") - 2)).otherwise(F.lit(1))
    stored = nodes.select("g", "level", "idx", "digest", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    asked = requested(rows).withColumn("copy", F.col("run") % copies)
    found = asked.join(stored, ["g", "level", "idx", "copy"]).groupBy("g", "run").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "digest"))).alias("near"))

    def side(level: Column, here) -> Column:
        return joined(F.transform(F.filter("near", lambda x: (x["level"] == level) & here(x["idx"])), lambda x: x["digest"]))

    def step(level: Column, own: Column) -> Column:
        return F.struct(side(level, lambda i: i < own).alias("left"), side(level, lambda i: i > own).alias("right"))

    # the steps above the lowest level, once for each run
    above = F.transform(F.sequence(F.lit(1), F.col("height") - 1), lambda k: step(k, F.floor(F.col("run") / power(k - 1))))
    out = rows.withColumn("run", F.floor(F.col("pos") / FAN)).join(found, ["g", "run"], "left").withColumn("height", height(F.col("n")))
    steps = F.when(F.col("height") > 1, F.concat(F.array(step(F.lit(0), F.col("pos"))), above)).when(F.col("height") == 1, F.array(step(F.lit(0), F.col("pos"))))
    return out.withColumn("steps", F.coalesce(steps, F.expr("cast(array() as array<struct<left: string, right: string>>)"))).drop("near", "height", "run")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof_text(steps: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return joined(F.transform(steps, lambda x: F.concat(x["left"], x["right"])))


def grouped(docs: DataFrame, group: str, order: str, **columns: Column) -> DataFrame:
    """g, ord and the columns; the name of a group sorts as the group does, null first."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(g.alias("g"), F.col(order).alias("ord"), *[c.alias(k) for k, c in columns.items()])


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields=FIELDS, claimed: Column | None = None) -> DataFrame:
    """ord, leaf, claimed, subroot, root, steps of every row.

    claimed: the leaf of the row as someone shows it, by default its own; `folded(claimed, steps)`
    is then compared with the root.
    """
    own = leaf(fields)
    leaves = written(grouped(docs, group, order, digest=own, claimed=own if claimed is None else claimed), "leaves")
    rows, parts = placed(leaves, "places")
    nodes = tree(rows, parts, "nodes")
    sub = tops(nodes).select(F.lit("").alias("g"), F.col("g").alias("ord"), "digest")
    sub_rows, sub_parts = placed(written(sub, "subroots"), "subroot-places")
    sub_nodes = tree(sub_rows, sub_parts, "subroot-nodes")
    root = tops(sub_nodes).first()  # one row, or none for an empty table
    of_group = proven(sub_rows, sub_nodes).select(F.col("ord").alias("g"), F.col("digest").alias("subroot"), F.col("steps").alias("up"))
    # what holds for a group reaches its leaves by its ranges, of which none is larger than the others
    by_part = written(parts.join(of_group, "g").select("g", "part", "subroot", "up"), "group-paths")
    out = proven(rows, nodes).join(by_part, ["g", "part"])
    return out.select(
        "ord", F.col("digest").alias("leaf"), "claimed", "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), F.concat("steps", "up").alias("steps")
    )


def tampered_leaf(fields=FIELDS) -> Column:
    """The leaf of a row whose text was changed where 3 divides the id's CRC: A-Z become a-z."""
    changed = leaf(fields, text=F.translate("text", UPPER, LOWER))
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed).otherwise(leaf(fields))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, held against a copy changed in part."""
    out = manifest(docs, claimed=tampered_leaf())
    return out.select(
        F.col("ord").alias("doc_id"), "leaf", "subroot", "root", digest(proof_text(F.col("steps"))).alias("proof_sha256"), folded(F.col("claimed"), F.col("steps")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
