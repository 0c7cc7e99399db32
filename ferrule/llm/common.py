"""What the corpus operators share: reading tables, and tables written in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space and the words of every contract here, as a character class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ferrule-"))
    return sc.getCheckpointDir()


#: Spark's setting by which the shuffle files of a job go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ferrule-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def erased(*tables: DataFrame) -> None:
    """Remove tables that `written` returned, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "written_at", None)
        if isinstance(path, str):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


#: Rows and bytes of a batch that goes to Python: what a worker holds at once doesn't grow with texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to BATCH_ROWS and BATCH_BYTES, if they are higher."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which grows with the cluster and its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_at_least(n: int, base: int) -> int:
    """The least power of base that is n or more."""
    p = base
    while p < n:
        p *= base
    return p


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of a summary that is sent to every executor: 8 MB, whatever the input.
SUMMARY_BITS = 1 << 26


#: The two columns that name a row.
ROW = ("row_key", "row_check")


def row_key():
    """A hash of a row's id and text; with row_check, 128 bits by which its decision finds it again."""
    return F.xxhash64("doc_id", "text")


def row_check():
    """A second hash of a row's id and text, by other seeds."""
    return F.xxhash64(F.lit("check"), "text", F.lit("check"), "doc_id")


def summary(keys: DataFrame, name: str):
    """The keys' bits in a bitmap of SUMMARY_BITS, on the driver: its size does not depend on the input.

    A key whose bit is unset is not among them; a set bit calls for an exact look-up.
    """
    bit = F.pmod(F.col(name), F.lit(SUMMARY_BITS)) + 1
    rows = (
        keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(SUMMARY_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        begin = (r.bucket - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def summarised(bits, keys):
    """Which of the keys (a numpy array of int64) may be in a summary."""
    bit = np.mod(keys, SUMMARY_BITS)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay, by decided (row_key, row_check, kept); of rows with one name that both stay and go, one stays.

    Rows that surely stay never move; only rows of which a copy goes are looked up.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gone = (
        decided.groupBy(*ROW)
        .agg(F.bool_or("kept").alias("some_stay"), F.bool_or(~F.col("kept")).alias("some_go"))
        .where("some_go")
        .drop("some_go")
    )
    gone = written(gone, "gone")
    shared = spark.sparkContext.broadcast(summary(gone, "row_key"))

    def check(keys: pd.Series) -> pd.Series:
        return pd.Series(summarised(shared.value, keys.to_numpy("int64")))

    may_go = F.pandas_udf(check, "boolean")

    columns = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], row_key().alias("row_key"), row_check().alias("row_check"))
    keyed = keyed.withColumn("may_go", may_go("row_key"))
    looked = keyed.where("may_go").join(gone, list(ROW), "left")
    stay = keyed.where(~F.col("may_go")).drop(*ROW, "may_go")
    new = looked.where(F.col("some_stay").isNull())
    one = looked.where("some_stay").dropDuplicates(list(ROW))
    out = stay
    for more in (new, one):
        out = out.unionByName(more.select(stay.columns))
    return out.toDF(*columns)
