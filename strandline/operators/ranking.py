"""First rows, best rows and cut-offs inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_with_cutoff(df: DataFrame, key: str, score: str, order: list, k: int, floor: float, relative: float) -> DataFrame:
    """The best k rows of each key, with `accepted`: the score reaches `floor` and `relative` of the key's best."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *order)
    top = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = F.max(score).over(Window.partitionBy(key))
    return top.withColumn("accepted", F.col(score) >= F.greatest(F.lit(floor), best * relative))


def match_type(best: Column, second: Column, moved: float, low: float, margin: float) -> Column:
    """Ambiguous where two candidates are good and near each other; else moved, low confidence or added."""
    close = (best >= moved) & (second >= moved) & (best - second < margin)
    return F.when(close, "ambiguous").when(best >= moved, "moved").when(best >= low, "low_confidence").otherwise("added")


def change_points(df: DataFrame, key: str, order: list, state: list[str]) -> DataFrame:
    """Rows whose state differs from the row before, nulls being equal to nulls; the first row of a key is one."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*state)
    first = F.row_number().over(w) == 1
    return df.withColumn("_c", first | ~F.lag(now).over(w).eqNullSafe(now)).where("_c").drop("_c")


def majority(df: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label of each key; ties go to the greater label. Counted before the shuffle by key."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", label)).alias("m"))
    return best.select(key, F.col(f"m.{label}").alias(label), F.col("m.n").alias("n"))
