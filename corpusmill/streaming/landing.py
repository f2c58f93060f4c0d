"""Structured streams over landing folders: late and repeated deliveries, event windows, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deliveries(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of delivered files from a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(stream: DataFrame, key: str = "file_id", time: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts by event-time window."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), by, "events")


def limited(stream: DataFrame, key: str, time: str, per_second: float, burst: int) -> DataFrame:
    """Token buckets by key: (key, time, allowed), state kept across batches."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), 0.0)
        for b in batches:
            out = []
            for t in sorted(b[time]):
                now = t.timestamp()
                tokens = min(burst, tokens + max(0.0, now - last) * per_second) if last else float(burst)
                last = max(last, now)
                ok = tokens >= 1
                tokens -= 1 if ok else 0
                out.append((k[0], t, ok))
            yield pd.DataFrame(out, columns=[key, time, "allowed"])
        state.update((tokens, last))

    kind = dict(stream.dtypes)[key]
    return stream.select(key, F.col(time).cast("timestamp").alias(time)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {time} timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop; results go to Parquet files that a rerun continues."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start().awaitTermination()
