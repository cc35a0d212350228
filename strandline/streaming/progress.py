"""The event log as a stream.

`changes` keeps the last state of a key across micro-batches, so the stream gives the rows that the batch query
`ranking.change_points` gives. `latest` and `once` need no Python: they are watermarked aggregates and de-duplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

CHANGE = "user_id long, event_id long, event_type string"
STATE = "event_type string, seen boolean"


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """STM-01: event files as they arrive; `ts` becomes a timestamp for watermarks. A single file needs a glob pattern."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, seen = state.get if state.exists else (None, False)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        kind = None if pd.isna(r.event_type) else r.event_type
        if not seen or kind != last:
            out.append((int(key[0]), int(r.event_id), kind))
        last, seen = kind, True
    state.update((last, seen))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])


def changes(events: DataFrame) -> DataFrame:
    """WIN-05, STM-01: events that change their user's state. Events must arrive in order from one micro-batch to the
    next; inside one they are sorted. State is one row for each user; rows without a user are dropped."""
    keyed = events.where("user_id is not null").select("user_id", "event_id", "event_type", "ts")
    return keyed.groupBy("user_id").applyInPandasWithState(_changed, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


HELD = "event_type string, seen boolean, newest long, ts array<long>, ids array<long>, kinds array<string>"
QUIET = "1 day"


def _in_order(quiet_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Events wait until the watermark has passed them, and then change the state in order of time and id."""
        last, seen, newest, *held = state.get if state.exists else (None, False, 0, [], [], [])
        waiting = list(zip(*held))
        for pdf in frames:
            kinds = (None if pd.isna(x) else x for x in pdf["event_type"])
            waiting += zip((pdf["ts"].astype("int64") // 1_000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else pdf["ts"].astype("datetime64[us]").astype("int64")), map(int, pdf["event_id"]), kinds)
        passed, out = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda x: x[:2])
        while waiting and waiting[0][0] < passed * 1_000:
            at, event, kind = waiting.pop(0)
            if not seen or kind != last:
                out.append((int(key[0]), event, kind))
            last, seen, newest = kind, True, max(newest, int(at) // 1_000)
        if not waiting and state.hasTimedOut and newest + quiet_ms <= passed:
            state.remove()
        else:
            state.update((last, seen, newest, *([list(x) for x in zip(*waiting)] or [[], [], []])))
            due = int(waiting[0][0]) // 1_000 + 1 if waiting else newest + quiet_ms
            state.setTimeoutTimestamp(max(due, passed + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    return run


def ordered_changes(events: DataFrame, late: str = "1 hour", quiet: str = QUIET) -> DataFrame:
    """WIN-05, STM-01, STM-02: as `changes`, for events that arrive in any order within `late`: an event counts once the
    watermark has passed it, so the rows are those of the batch query. Rows later than the watermark, and rows without a
    user, are dropped. A user's state ends `quiet` after its newest event; the next one is a first event again."""
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1_000)
    keyed = events.where("user_id is not null").withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts")
    return keyed.groupBy("user_id").applyInPandasWithState(_in_order(quiet_ms), CHANGE, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def latest(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STM-02: each user's newest event; update mode."""
    return events.withWatermark("ts", late).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STM-04: each event id once while its watermark lasts."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def per_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Windowed counts by event type, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """STM-03: process what has arrived and stop."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def run_upserts(df: DataFrame, spark_table_path: str, checkpoint: str, key: str, order: str | None = None) -> None:
    """SNK-02: keyed merge of updates into a Parquet table, a micro-batch at a time; of several updates of a key in one
    batch the newest by `order` wins (needed unless the stream gives each key once a batch)."""
    from strandline.sources.sinks import upsert

    q = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    q = q.foreachBatch(lambda batch, _: upsert(batch, spark_table_path, [key], order))
    q.trigger(availableNow=True).start().awaitTermination()
