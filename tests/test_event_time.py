"""Changes in event-time order from a stream that arrives shuffled."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strandline.operators.ranking import change_points
from strandline.streaming import progress

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, event_type string, ts timestamp"


def arrive(spark, folder, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def found(spark, tmp_path, files, **kwargs):
    arrive(spark, tmp_path / "in", files)
    schema = spark.read.parquet(str(tmp_path / "in" / "000")).schema
    stream = progress.event_stream(spark, str(tmp_path / "in" / "*"), schema)
    progress.run_available(progress.ordered_changes(stream, **kwargs), str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id", "event_type").collect()), key=str)


def test_shuffled_arrival_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.choice([1, 2, 3, None]), k, rng.choice(["a", "a", "b", None]), BEGIN + dt.timedelta(minutes=rng.randint(0, 200))) for k in range(150)]
    by_time = sorted(events, key=lambda e: e[3] + dt.timedelta(minutes=rng.randint(0, 50)))  # up to 50 minutes late
    files = [by_time[k : k + 30] for k in range(0, 150, 30)] + [[(9, 999, "end", BEGIN + dt.timedelta(days=2))]]
    got = found(spark, tmp_path, files, late="1 hour", quiet="30 days")
    df = spark.createDataFrame([e for e in events if e[0] is not None], SCHEMA)
    want = change_points(df, "user_id", [F.col("ts"), F.col("event_id")], ["event_type"]).select("user_id", "event_id", "event_type")
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) > 40


def test_state_ends_after_a_quiet_time(spark, tmp_path):
    """The same state a month later is a first event again; an hour later it is none."""
    def at(**kwargs):
        return BEGIN + dt.timedelta(**kwargs)

    files = [[(1, 1, "a", at()), (2, 2, "a", at())], [(2, 3, "a", at(hours=1))], [(9, 4, "x", at(days=10))], [(9, 5, "x", at(days=20))], [(1, 6, "a", at(days=30))], [(9, 7, "x", at(days=60))], [(9, 8, "x", at(days=61))]]
    got = found(spark, tmp_path, files, late="1 minute", quiet="2 days")
    assert [r for r in got if r[0] in (1, 2)] == [(1, 1, "a"), (1, 6, "a"), (2, 2, "a")]
