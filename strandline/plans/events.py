"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import scores as S
from strandline.operators import ranking
from strandline.plans.registry import Tables, query


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t: Tables):
    """WIN-04, STM-04, FLT-12: each user's newest event, as a maximum that is combined before the shuffle."""
    newest = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m")
    return t.events.groupBy("user_id").agg(newest).select("user_id", "m.event_id", "m.event_type", "m.value")


@query(
    "event_change_detect",
    """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE r = 1 OR before IS DISTINCT FROM event_type""",
)
def event_change_detect(t: Tables):
    """WIN-05, STM-01: events that change a user's state."""
    return ranking.change_points(t.events, "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("majority_label", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def majority_label(t: Tables):
    """AGG-06: each user's most frequent event type."""
    return ranking.majority(t.events, "user_id", "event_type")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"detail\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS merged FROM events")
def json_props(t: Tables):
    """JSN-01, JSN-02, JSN-04: typed properties, and a shallow merge."""
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("detail"), k.alias("k"))).alias("merged"))


@query(
    "timestamp_from_id",
    """SELECT event_id, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(2000 + y, m, 1) END AS month FROM (
    SELECT event_id, CAST(event_id % 25 AS BIGINT) AS y, CAST(event_id % 15 AS BIGINT) AS m FROM events)""",
)
def timestamp_from_id(t: Tables):
    """DAT-01: the month that a YYMM prefix made from each id names, null for months over 12."""
    prefix = F.concat(F.lpad((F.col("event_id") % 25).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 15).cast("string"), 2, "0"), F.lit(".01234"))
    return t.events.select("event_id", S.month_of_id(prefix).alias("month"))


@query("predates", """SELECT event_id, CAST(ts AS DATE) <= DATE '2024-01-15' AS predates, least(0.62e0 + 0.05e0 * (event_id % 5) + CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-15' THEN 0.08e0 ELSE 0e0 END, 0.9e0) AS confidence FROM events""")
def predates(t: Tables):
    """DAT-03: a bonus for what was there before the date."""
    early = F.to_date("ts") <= F.lit("2024-01-15").cast("date")
    bonus = F.when(early, F.lit(0.08)).otherwise(F.lit(0.0))
    return t.events.select("event_id", early.alias("predates"), F.least(0.62 + 0.05 * (F.col("event_id") % 5) + bonus, F.lit(0.9)).alias("confidence"))


@query(
    "interval_overlap",
    """WITH r AS (SELECT user_id, min(event_id) AS a, min(event_id) + 500 AS b FROM events GROUP BY user_id)
    SELECT e.user_id, e.event_type, count(*) AS n FROM events e JOIN r ON e.user_id = r.user_id AND e.event_id > 0 AND r.a > 0 AND e.event_id <= r.b AND r.a <= e.event_id + 10 GROUP BY ALL""",
)
def interval_overlap(t: Tables):
    """JON-09, FLT-09: events whose range of ids overlaps their user's first one; equal keys join, ranges filter."""
    first = t.events.groupBy("user_id").agg(F.min("event_id").alias("a")).withColumn("b", F.col("a") + 500)
    df = t.events.join(first, "user_id").where(S.ranges_overlap(F.col("event_id"), F.col("event_id") + 10, F.col("a"), F.col("b")))
    return df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "status_priority",
    """SELECT user_id, bool_and(event_type = 'purchase') AS all_purchase, bool_or(event_type = 'error') AS any_error,
    CASE WHEN bool_and(event_type = 'purchase') THEN 'mapped' WHEN bool_or(event_type = 'purchase') THEN 'partially_mapped' WHEN bool_or(event_type = 'view') THEN 'refining' ELSE 'unmapped' END AS status FROM events GROUP BY user_id""",
)
def status_priority(t: Tables):
    """AGG-07: a status from all and any."""
    e = F.col("event_type")
    every, some, view = F.bool_and(e == "purchase"), F.bool_or(e == "purchase"), F.bool_or(e == "view")
    status = F.when(every, "mapped").when(some, "partially_mapped").when(view, "refining").otherwise("unmapped")
    return t.events.groupBy("user_id").agg(every.alias("all_purchase"), F.bool_or(e == "error").alias("any_error"), status.alias("status"))


@query("progress_percent", """SELECT user_id, max(pos) AS stage, round((count(*) % 7 + 0.5e0) / 8e0 * 100, 6) AS percent FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) GROUP BY user_id""")
def progress_percent(t: Tables):
    """CLI-10: percent of stages done."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = t.events.select("user_id", F.row_number().over(w).cast("long").alias("pos"))
    return df.groupBy("user_id").agg(F.max("pos").alias("stage"), F.round((F.count("*") % 7 + 0.5) / 8.0 * 100, 6).alias("percent"))
