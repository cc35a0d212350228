"""Sinks and state tables on Parquet. A version of a table is written whole beside the old one and named by a marker
file that is written last, so a reader sees one version or the other, and a lost executor or driver leaves the old."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, table: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    p, fs = _fs(spark, table)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(v for v in found if fs.exists(_fs(spark, f"{table}/v={v}/_SUCCESS")[0]))


def publish(df: DataFrame, table: str, keep: int = 2) -> int:
    """SNK-06: write a new version; the commit protocol's _SUCCESS file makes it visible. Older ones than `keep` go."""
    spark, old = df.sparkSession, versions(df.sparkSession, table)
    new = (old[-1] if old else 0) + 1
    df.write.mode("overwrite").parquet(f"{table}/v={new}")
    for v in [*old, new][:-keep]:
        p, fs = _fs(spark, f"{table}/v={v}")
        fs.delete(p, True)
    return new


def read(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest complete version; null if there is none."""
    found = versions(spark, table)
    return spark.read.parquet(f"{table}/v={found[-1]}") if found else None


def upsert(updates: DataFrame, table: str, keys: list[str], order: str | None = None) -> None:
    """SNK-02, SNK-03, SNK-04: a full outer join by key in which non-null fields of the update win (the latest by
    `order`, where a key has several). Empty strings count as missing."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(order) if order else F.lit(0))
    updates = updates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    old = read(updates.sparkSession, table)
    if old is None:
        publish(updates, table)
        return
    rest = [c for c in old.columns if c not in keys]

    def value(c: str):
        if c not in updates.columns:
            return F.col(f"o.{c}").alias(c)
        new = F.col(f"n.{c}")
        if dict(updates.dtypes)[c] == "string":
            new = F.nullif(new, F.lit(""))
        return F.coalesce(new, F.col(f"o.{c}")).alias(c)

    joined = old.alias("o").join(updates.alias("n"), keys, "full_outer")
    publish(joined.select(*keys, *map(value, rest)), table)


def append_changed(events: DataFrame, table: str, key: str, state: list[str], order: str) -> None:
    """SNK-01, SNK-05: append events whose state differs from the key's last one in the table or the batch."""
    from strandline.operators.ranking import change_points

    old = read(events.sparkSession, table)
    if old is None:
        publish(change_points(events, key, [order], state), table)
        return
    last = old.groupBy(key).agg(F.max_by(F.struct(*old.columns), order).alias("s")).select("s.*")
    both = last.withColumn("_old", F.lit(True)).unionByName(events.select(*old.columns).withColumn("_old", F.lit(False)))
    fresh = change_points(both, key, [order], state).where(~F.col("_old")).drop("_old")
    publish(old.unionByName(fresh), table)


def migrate(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """SNK-09: add missing columns as nulls of the given types (arrays as empty arrays)."""
    for name, kind in added.items():
        if name not in df.columns:
            df = df.withColumn(name, F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind))
    return df


def write_artifacts(files: DataFrame, folder: str, key: str = "cache_key") -> None:
    """SNK-07: JSON payloads by cache key; only the partitions present in `files` are replaced."""
    (files.withColumn("payload", F.to_json(F.struct(*[c for c in files.columns if c != key]))).select(key, "payload")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(folder))
