"""Tables written in the cluster's shared folder, where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


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


#: Rows up to which a relation is one partition: joins and distincts of such relations need no exchange.
SMALL = 50_000


#: Rows above which a written relation is never broadcast: Spark goes by the size of its files, which is
#: a fraction of what passes through the driver, and a fixpoint would send it in every round.
LARGE = 200_000


def one_partition(df: DataFrame, rows: int) -> DataFrame:
    """df in one partition if its number of rows is small, and shuffled where it is joined if that is large."""
    if rows <= SMALL:
        return df.coalesce(1)
    return df.hint("merge") if rows > LARGE else df


def light(df: DataFrame, rows: int) -> DataFrame:
    """df with its number of rows, sent to the rows that it is joined with if it is small: these are scanned, not shuffled."""
    return F.broadcast(df) if rows <= SMALL else df


#: Rows and bytes of a batch that goes to Python: what a worker holds at once doesn't grow with the input.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to BATCH_ROWS and BATCH_BYTES, if they are higher."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to all cores: where rows cost far more than their bytes tell, files make too few tasks of them."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def stored(df: DataFrame) -> DataFrame:
    """df as a written table."""
    return counted(df)[0]


def counted(df: DataFrame, small: bool = False) -> tuple[DataFrame, int]:
    """df as a written table, and its number of rows, from one job; small plans run without generated code."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ferrule-facts-{uuid.uuid4().hex}"
    seen, whole = Observation(), "spark.sql.codegen.wholeStage"
    before = spark.conf.get(whole)
    try:
        if small:  # compiling such plans takes longer than running them
            spark.conf.set(whole, "false")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    finally:
        spark.conf.set(whole, before)
    n = seen.get["n"]
    return one_partition(spark.read.schema(df.schema).parquet(path), n), n
