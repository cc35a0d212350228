"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the same key, so a hub with many neighbours is summed before the shuffle
and its join can be split. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session, whose tasks share the driver's disk, may do
    without one; a cluster's would lose its checkpoints with a host."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _down(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach. Nodes that are the smallest of
    their component, and nodes without edges, have no row. The result is checkpointed."""
    e = checkpointed(_down(edges))
    state = _state(e)
    while state[0]:
        e = checkpointed(_small(_large(e)))
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"] or 0
