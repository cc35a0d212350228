"""Order-dependent folds inside one key, as aggregates over a sorted array: one row holds one key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sorted(df: DataFrame, key: str, order: str, text: str, limit: int | None) -> DataFrame:
    x = F.length(F.left(F.col(text), F.lit(limit)) if limit else F.col(text)).cast("long")
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), x.alias("n"))))
    return df.groupBy(key).agg(F.transform(items, lambda s: s["n"]).alias("sizes"))


def running_budget(df: DataFrame, key: str, order: str, text: str, sections: int, section_chars: int, total: int, least: int) -> DataFrame:
    """How many texts fit, in order, and their characters. Each is cut to `section_chars`, the last to what is left;
    it ends after `sections` or when fewer than `least` characters are left."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("used"), zero.alias("taken"), F.lit(False).alias("stop"))

    def step(a, n):
        used = a["used"] + F.least(n, F.lit(total) - a["used"])
        stop = (a["taken"] + 1 >= sections) | (F.lit(total) - used < least)
        new = F.struct(used.cast("long").alias("used"), (a["taken"] + 1).alias("taken"), stop.alias("stop"))
        return F.when(a["stop"], a).otherwise(new)

    out = _sorted(df, key, order, text, section_chars).select(key, F.aggregate("sizes", start, step).alias("a"))
    return out.select(key, F.col("a.taken").alias("sections"), F.col("a.used").alias("chars"))


def pack_batches(df: DataFrame, key: str, order: str, text: str, sections: int, total: int, most: int, section_chars: int | None = None) -> DataFrame:
    """Batch sizes: texts, each cut to `section_chars`, fill a batch up to `sections` or `total` characters; what follows `most` batches is left out."""
    empty = F.array().cast("array<struct<texts:bigint,chars:bigint>>")
    start = F.struct(empty.alias("full"), F.lit(0).cast("long").alias("texts"), F.lit(0).cast("long").alias("chars"))

    def step(a, n):
        over = (a["texts"] > 0) & ((a["texts"] >= sections) | (a["chars"] + n > total))
        closed = F.concat(a["full"], F.array(F.struct(a["texts"].alias("texts"), a["chars"].alias("chars"))))
        return F.struct(
            F.when(over, closed).otherwise(a["full"]).alias("full"),
            F.when(over, F.lit(1).cast("long")).otherwise(a["texts"] + 1).alias("texts"),
            F.when(over, n).otherwise(a["chars"] + n).alias("chars"),
        )

    last = F.array(F.struct(F.col("a.texts").alias("texts"), F.col("a.chars").alias("chars")))
    out = _sorted(df, key, order, text, section_chars).select(key, F.aggregate("sizes", start, step).alias("a"))
    out = out.select(key, F.posexplode(F.slice(F.concat(F.col("a.full"), last), 1, most)).alias("batch", "b"))
    return out.select(key, "batch", "b.texts", "b.chars")
