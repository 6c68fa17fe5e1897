"""Streams: events into memory, reviews as micro-batches, rolling state by session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ingest import memory_chunks


def ingest(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of events to the memory table at ``path``; ids that are there already are left out, so replays add nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = memory_chunks(batch).dropDuplicates(["id"])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(path).select("id"), "id", "left_anti")
        rows.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Memory rows of a stream of events, each id once within the watermark of ingested_at."""
    return memory_chunks(events).withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["id"])


def review(memory: DataFrame, checkpoint: str, form: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Hand new memory to ``form`` in micro-batches; what was seen is kept in the checkpoint, in place of a mark on each row."""
    return memory.where("category = 'memory'").writeStream.foreachBatch(lambda batch, _: form(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def recent_injections(injections: DataFrame, size: int = 15) -> DataFrame:
    """(session_id, recent) from a stream of (session_id, id): the last distinct ids of each session, as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, parts, state: GroupState):
        ids = list(state.get[0]) if state.exists else []
        for part in parts:
            for x in part["id"]:
                if x not in ids:
                    ids.append(x)
        ids = ids[-size:]
        state.update((ids,))
        yield pd.DataFrame({"session_id": [key[0]], "recent": [ids]})

    return injections.groupBy("session_id").applyInPandasWithState(update, "session_id string, recent array<string>", "recent array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window, event_type, n) of a stream of (ts, event_type), late events within the delay included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
