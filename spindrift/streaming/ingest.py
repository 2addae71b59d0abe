"""Streams of listings and scan outcomes.

The batch operators define the results; a stream gives the same rows in micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import tables


def read_listings(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Landed JSON listings as a stream; rows that can't be read come with nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def without_repeats(stream: DataFrame, keys: list[str], at: str = "fetched_at", delay: str = "2 days") -> DataFrame:
    """First row of each key within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def rolling_health(events: DataFrame, at: str = "ts") -> DataFrame:
    """(start, source_id, errors, warnings) over the last seven days, each day anew; late events up to a day."""
    level = F.upper("event_type")
    week = F.window(at, "7 days", "1 day")
    counts = events.withWatermark(at, "1 day").groupBy(week.alias("w"), F.col("user_id").alias("source_id"))
    return counts.agg(F.count_if(level == "ERROR").alias("errors"), F.count_if(level == "CLICK").alias("warnings")).select(F.col("w.start").alias("start"), "source_id", "errors", "warnings")


def upsert_each_batch(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str, bucket_rows: int = tables.BUCKET_ROWS):
    """Keeps one row per key, the latest by ``order``, in the table in the folder ``table`` (tables.current reads it).

    A batch writes its own number as the version of the table, so that a batch which runs again after a failure gives
    the same; it touches only the buckets that its keys fall into, and these split as they grow."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: tables.upsert(batch, table, keys, order, number, bucket_rows))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def newer_than_cursor(stream: DataFrame, cursors: DataFrame, at: str = "published_at") -> DataFrame:
    """Rows newer than their source's cursor (source_id, cursor), and all without a date or of sources without one."""
    rows = stream.join(F.broadcast(cursors), "source_id", "left")
    return rows.where(F.col(at).isNull() | F.col("cursor").isNull() | (F.col(at) > F.col("cursor"))).drop("cursor")


class _Misses(StatefulProcessor):
    """Consecutive misses of one member: ``classified`` starts anew, ``invalid`` changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.misses = handle.getValueState("misses", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.misses.get()[0] if self.misses.exists() else 0
        for part in rows:
            out = []
            for event, outcome in part.sort_values(["ts", "event_id"])[["event_id", "outcome"]].itertuples(index=False):
                n = n + 1 if outcome == "missing" else 0 if outcome == "classified" else n
                out.append((key[0], event, n, "closed" if n >= 3 else "classified" if outcome == "classified" else "pending"))
            self.misses.update((n,))
            yield pd.DataFrame(out, columns=["source_id", "event_id", "misses", "state"])

    def close(self) -> None:
        pass


def member_states(outcomes: DataFrame) -> DataFrame:
    """(source_id, event_id, misses, state) of a stream of outcomes that arrives in order per source; the rows
    that state.miss_runs gives for the whole. Needs the RocksDB state store."""
    return outcomes.groupBy("source_id").transformWithStateInPandas(_Misses(), "source_id long, event_id long, misses int, state string", outputMode="Append", timeMode="None")
