"""Structured Streaming forms: windows with watermarks, deduplication, sessions, stateful detection, change feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """(start, key, n, total) of tumbling windows; with ``late``, a watermark that closes them (streams)."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, ts: str, value: str, width: str, slide: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, stop, n) of sessions parted by gaps."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """Events by key once within the watermark; on a batch, once."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def online_crossing(points: DataFrame, key: str, crossed: str, run: int = 3) -> DataFrame:
    """(key, at): when a key first has ``run`` crossings in a row; state is the run so far and the points seen.

    points is (key, place, crossed) with places in order within a micro-batch.
    """

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, done = state.get if state.exists else (0, False)
        for part in parts:
            for place, hit in part.sort_values("place")[["place", crossed]].itertuples(index=False):
                length = length + 1 if hit else 0
                if length == run and not done:
                    done = True
                    yield pd.DataFrame({key: [k[0]], "at": [int(place) - run + 1]})
        state.update((length, done))

    return points.groupBy(key).applyInPandasWithState(update, f"{key} long, at long", "length int, done boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available into a named table (for checks; a service would keep it running)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_stream(changes: DataFrame, target: str, checkpoint: str, key: str = "id"):
    """Keep a Parquet table in step with a stream of changed rows: each micro-batch replaces the rows of its keys in a new version folder."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.dropDuplicates([key])
        if number == 0:
            merged = latest
        else:
            merged = spark.read.parquet(f"{target}/v={number - 1}").join(latest.select(key), key, "left_anti").unionByName(latest)
        merged.write.mode("overwrite").parquet(f"{target}/v={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def journal(turns: DataFrame, key: str, ts: str, late: str = "1 hour", enough: int = 15, wait_hours: int = 72) -> DataFrame:
    """(key, n, reason): sessions due for consolidation, each once: when ``enough`` turns have come, or ``wait_hours`` after the last turn.

    State is a counter and the time of the last turn of each session; the wait is a timer on
    event time, so it ends when the watermark (``late`` behind the newest turn) has passed it.
    """

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, told = state.get if state.exists else (0, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not told:
                yield pd.DataFrame({key: [k[0]], "n": [n], "reason": ["wait"]})
            return
        for part in parts:
            n += len(part)
            last = max(last, int(part[ts].max().timestamp() * 1000))
        if n >= enough and not told:
            told = True
            yield pd.DataFrame({key: [k[0]], "n": [n], "reason": ["count"]})
        state.update((n, last, told))
        state.setTimeoutTimestamp(max(last + wait_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    dated = turns.withWatermark(ts, late)
    return dated.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, reason string", "n long, last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
