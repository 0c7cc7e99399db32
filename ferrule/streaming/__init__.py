"""Incremental modules and typestate over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_modules(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """module, text, crc of the modules whose text differs from cache(module, crc)."""
    now = texts.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    return now.join(cache.select("module", "crc"), ["module", "crc"], "left_anti")


def write_modules(functions: DataFrame, path: str) -> None:
    """Replace the partitions of the modules in functions, and no others."""
    functions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def keep_current(stream: DataFrame, parse, path: str, checkpoint: str):
    """A query that parses the files of a stream (module, text) and replaces the modules they hold."""

    def batch(df: DataFrame, _: int) -> None:
        write_modules(parse(df), path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def typestate_stream(events: DataFrame, transitions: list[tuple[str, str, str]], initial: str) -> DataFrame:
    """obj, ord, state, event: the state changes of objects in a stream of (obj, ord, event), in order of arrival.

    State is one string for each object.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    step = {(a, e): b for a, e, b in transitions}

    def run(key, batches, state):
        now = state.get[0] if state.exists else initial
        for batch in batches:
            out = []
            for e in batch.sort_values("ord").itertuples():
                new = step.get((now, e.event), now)
                if new != now:
                    out.append((key[0], e.ord, new, e.event))
                now = new
            yield pd.DataFrame(out, columns=["obj", "ord", "state", "event"])
        state.update((now,))

    return events.groupBy("obj").applyInPandasWithState(run, "obj long, ord long, state string, event string", "state string", "append", GroupStateTimeout.NoTimeout)
