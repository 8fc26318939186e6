"""Scans as a stream: each item's last version is its state, and every batch of observations logs what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_changes(spark: SparkSession, source: str, schema: str, key: str, version: str, time: str, out: str, files: int = 1) -> DataFrame:
    """The change log (key, change, batch) of the Parquet files of ``source``, ``files`` of them a batch, until all are read.

    A batch's last observation of an item counts: added, updated, unchanged, or failed where it has no version, which
    leaves the state as it was. The state is keyed and kept by the stream, so a batch costs what its own items cost. ``out`` gets the
    log and the stream's checkpoint. A batch that is run again writes its own folder again, so a restart neither loses nor repeats changes.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    kinds = dict(stream.dtypes)

    def change(item: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        for rows in batches:
            for seen, found in zip(rows["seen"], rows["found"]):
                at = (seen, "" if found is None or found != found else str(found))
                if last is None or at > last[0]:
                    last = (at, None if found is None or found != found else found)
        if last is None:
            return
        now, before = last[1], state.get[0] if state.exists else None
        if now is None:
            kind = "failed"
        else:
            kind = "added" if before is None else "unchanged" if before == now else "updated"
            state.update((now,))
        yield pd.DataFrame({key: [item[0]], "change": [kind]})

    observed = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("seen"), F.col(version).alias("found"))
    changes = observed.groupBy(key).applyInPandasWithState(
        change, f"`{key}` {kinds[key]}, change string", f"version {kinds[version]}", "update", GroupStateTimeout.NoTimeout
    )

    def log(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/log/number={number}")

    query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"`{key}` {kinds[key]}, change string, batch int").parquet(f"{out}/log").select(key, "change", "batch")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Counts of a stream (or table) of events by window and group; events later than ``late`` are dropped from a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
