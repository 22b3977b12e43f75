"""Streams: ingestion into a table, windowed counts, conversation memory with state, a cache whose entries expire."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import chunking


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, or of the one file that path names, so many at a trigger.

    A stream watches folders: for a file its folder is watched with the file's name as filter. Times without a zone are taken in the session's.
    """
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    is_folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    found = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", name).parquet(folder)
    return found.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in found.schema))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events in tumbling windows; what is later than the watermark goes uncounted."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user with no gap longer than that."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def ingest(docs: DataFrame, path: str, checkpoint: str) -> Any:
    """Chunks of a stream of documents, appended to a Parquet table until the source is read up. The same code as for a batch cuts each micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        chunking.chunk_rows(chunking.sliding_windows(batch)).write.mode("append").parquet(path)

    query = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def memory(turns: DataFrame, k: int = 5, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, turns, recent): after each micro-batch the last k turns of the conversations it touched.

    With idle_ms a conversation idle for so long is forgotten; such a stream runs on to see to it, so it needs a trigger by time.
    The state of a conversation holds k turns, however long it gets.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, held = state.get if state.exists else (0, [])
        new = pd.concat(list(batches)).sort_values("turn")
        held = [*held, *(f"{r}: {t}" for r, t in zip(new["role"], new["text"], strict=True))][-k:]
        n += len(new)
        state.update((n, held))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "recent": ["\n".join(held)]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turns long, recent string", "n long, held array<string>", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def fresh(cache: DataFrame, now: Any, ttl_seconds: int = 3600) -> DataFrame:
    """Entries of a cache (key, value, ts) not older than so many seconds, the newest of each key."""
    newest = cache.groupBy("key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    return newest.filter(F.col("ts") + F.make_interval(secs=F.lit(ttl_seconds)) > F.lit(now))


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream gives until its source is read up, as a table: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
