"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots; bytes are summed per slot; a map, kept as a
table of versions, says which shard each slot belongs to. Version 0 deals the slots round. A
run loads the latest version of the map that it is given (a new one where there is none) and
writes its edit as the next version: rebalancing moves only slots of shards above the mean, and
growing by a shard moves slots only into it. Older versions stay as they are. Only slot totals
and the map (SLOTS numbers, whatever the input) ever reach the driver.

Law: `bytes`, the shards' sizes are near equal. A hot record key cannot unbalance it, as the
hash takes the id and the text's checksum together, and the row's rank among its equals, too,
where equal rows have more than HOT times the bytes that a slot has on average.

Defined results: null text has no bytes and checksum 0; null doc_id hashes as null; repeated
rows are placed one by one, those equal in all respects in one slot if they are small; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_or_empty, written

SLOTS = 8192
SHARDS = 24
#: Fixed part of a record's size, in bytes.
RECORD_BYTES = 8
#: Equal rows are spread over slots beyond so many times a slot's mean bytes.
HOT = 4


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, checksum and virtual slot of every row."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(RECORD_BYTES)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def spread(rows: DataFrame, load: dict[int, int], slots: int) -> DataFrame | None:
    """rows, written, with slots by rank too for equal records that are too many bytes for one slot; None if there are none.

    Ranks number the equal rows of a record from 0, so where they go depends on their number alone.
    """
    most = HOT * sum(load.values()) / slots
    if max(load.values(), default=0) <= most:
        return None
    key = ["doc_id", "text_crc32"]
    # fewer than slots / HOT records can be so large
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > most))
    hot = written(hot.select(F.col("doc_id").alias("hot_id"), F.col("text_crc32").alias("hot_crc32"), F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        return None
    same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("text_crc32") == F.col("hot_crc32"))
    marked = rows.join(F.broadcast(hot), same, "left").select(*rows.columns, F.coalesce("hot", F.lit(False)).alias("hot"))
    # ranks: by partition first, a row for each partition of each record, then within it
    parts = marked.where("hot").groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("doc_id").alias("of"), F.col("text_crc32").alias("crc"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key, "part").orderBy("row")
    ranked = marked.where("hot").withColumn("i", F.row_number().over(inside))
    ranked = ranked.join(base, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_crc32") == F.col("crc")) & (F.col("part") == F.col("at")))
    salted = F.pmod(F.xxhash64(*key, F.col("base") + F.col("i")), F.lit(slots)).cast("int")
    columns = ["doc_id", "size", "text_crc32"]
    return written(marked.where("not hot").select(*columns, "vslot").unionByName(ranked.select(*columns, salted.alias("vslot"))), "spread")


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: slots dealt round."""
    return [s % shards for s in range(slots)]


def rebalanced(owner: list[int], load: dict[int, int], shards: int) -> list[int]:
    """The next version of a map: surplus slots of shards above the mean go to the emptiest."""
    owner = list(owner)
    mean = sum(load.values()) / shards
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    for slot in range(len(owner)):
        held[owner[slot]].append(slot)
    total, loose = dict.fromkeys(range(shards), 0), []
    for shard, own in held.items():
        for slot in sorted(own, key=lambda s: (-load.get(s, 0), s)):
            if total[shard] + load.get(slot, 0) <= mean:
                total[shard] += load.get(slot, 0)
            else:
                loose.append(slot)
    heap = [(t, k) for k, t in total.items()]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-load.get(s, 0), s)):
        t, k = heapq.heappop(heap)
        owner[slot] = k
        heapq.heappush(heap, (t + load.get(slot, 0), k))
    return owner


def grown(owner: list[int], load: dict[int, int], shards: int) -> list[int]:
    """The next version with one more shard, which takes slots from the fullest and only into itself."""
    owner, total = list(owner), dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    for slot in range(len(owner)):
        held[owner[slot]].append(slot)
        total[owner[slot]] += load.get(slot, 0)
    for own in held.values():
        own.sort(key=lambda s: (load.get(s, 0), s))
    mean, got = sum(total.values()) / (shards + 1), 0
    heap = [(-t, k) for k, t in total.items()]
    heapq.heapify(heap)
    while heap and got < mean:
        t, k = heapq.heappop(heap)
        while held[k] and not load.get(held[k][-1], 0):
            held[k].pop()
        if not held[k]:
            continue
        slot = held[k].pop()
        if got + load[slot] > mean:
            continue
        owner[slot] = shards
        got += load[slot]
        heapq.heappush(heap, (t + load[slot], k))
    return owner


def map_folder(spark: SparkSession) -> str:
    """A folder for a new map in the shared folder."""
    return f"{shared_dir(spark)}/ferrule-slot-map-{uuid.uuid4().hex}"


def stored_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The latest version of the map in a folder and its number; None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    versions = spark.read.schema("vslot int, shard int, version int").parquet(path)
    latest = versions.agg(F.max("version")).first()[0]
    if latest is None:
        return None
    rows = versions.where(F.col("version") == latest).collect()  # a row for each slot
    owner = [0] * len(rows)
    for r in rows:
        owner[r.vslot] = r.shard
    return latest, owner


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Add a version to the map in a folder; versions are written once."""
    rows = pa.table({"vslot": pa.array(range(len(owner)), pa.int32()), "shard": pa.array(owner, pa.int32())})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/version={version}")  # a row for each slot


def totals(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows of each virtual slot."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r.vslot: r.bytes for r in sums}, {r.vslot: r.n for r in sums}


def placed_by(rows: DataFrame, owner: list[int], count: dict[int, int], shards: int, version: int) -> DataFrame:
    """The columns of `shard` for records under a map."""
    base, start = [0] * shards, []
    for slot in range(len(owner)):  # where each virtual slot's rows begin in its shard
        start.append(base[owner[slot]])
        base[owner[slot]] += count.get(slot, 0)
    here = pa.table({"vslot": pa.array(range(len(owner)), pa.int32()), "shard": pa.array(owner, pa.int32()), "begins": pa.array(start, pa.int64())})
    here = F.broadcast(rows.sparkSession.createDataFrame(here))  # a row for each slot
    order = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        rows.withColumn("i", F.row_number().over(order))
        .join(here, "vslot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("begins") + F.col("i") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "vslot",
            F.lit(version).alias("map_version"),
        )
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot and map_version of every row.

    map_path: the folder of the map to load and edit. A map of fewer shards is grown, a shard at a
    time, before it is balanced; one of more shards or another number of slots is an error.
    """
    spark = docs.sparkSession
    path = map_path or map_folder(spark)
    known = stored_map(spark, path)
    if known is None:
        store_map(spark, path, 0, first_map(slots, shards))
        known = 0, first_map(slots, shards)
    version, owner = known
    held = max(owner) + 1
    if len(owner) != slots or held > shards:
        raise ValueError(f"the map in {path} has {len(owner)} slots and {held} shards")
    rows = written(records(docs, slots).withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "records")
    load, count = totals(rows)
    even = spread(rows, load, slots)
    if even is not None:
        rows = even
        load, count = totals(rows)
    for more in range(held, shards):
        owner = grown(owner, load, more)
    owner = rebalanced(owner, load, shards)
    store_map(spark, path, version + 1, owner)
    return placed_by(rows, owner, count, shards, version + 1)
