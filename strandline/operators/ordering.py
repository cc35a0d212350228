"""Places in a total order without moving all rows to one task, and broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows (of a few short columns), as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """`name`: the place of each row, from 1. Rows are range-partitioned by the order; each partition numbers its own,
    and starts where the partitions before it end. Only one count for each partition is gathered. The order's columns
    must tell all rows apart, so that a repeated computation gives the same places."""
    from strandline.operators.graph import checkpointed

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    out = ranged.join(F.broadcast(starts), "_part")  # one row for each partition
    return out.withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_part", "_start")
