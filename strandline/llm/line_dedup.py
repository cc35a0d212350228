"""Line de-duplication with keep bitmaps.

Lines are reduced to hashes of their keys. The hashes are range-partitioned together with a salt taken from the
document and sorted by key, document and position, so each partition streams the occurrences of a key in order: it
counts the documents and marks the first occurrence. The number of salts grows with the number of rows, so that a line
that a third of all documents hold is spread over tasks of bounded size; the sums over the salts decide. What comes
back for each document is a bitmap of lines to drop, 62 lines a word, with empty words left out; the text itself is
joined with it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import WHITE, cut, parts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS, ROWS_A_SALT = 32, 1 << 20  # at least so many salts, and one for so many rows
BITS = 62


def line_key(line):
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _marks(rows: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(row, word, bits): bitmap words of lines to drop. `rows` has row (a document's key) and text."""
    salts = max(SALTS, -(-rows.count() // ROWS_A_SALT))
    keyed = rows.select("row", F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("pos", "key"))
    keyed = keyed.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(7), F.length("key"), F.reverse("key")).alias("h2"),
        F.pmod(F.xxhash64("row.id"), F.lit(salts)).cast("int").alias("salt"),
        "row",
        "pos",
    )
    # Read three times (range bounds, stream, bitmaps): the texts are cut into lines once.
    keyed = cut(keyed)
    ranged = keyed.repartitionByRange(parts(rows.sparkSession), "h1", "h2", "salt")
    here = Window.partitionBy("h1", "h2", "salt").orderBy("row", "pos")
    # Rows of one id are neighbours, as the salt is the id's and the order begins with it.
    before = F.lag("row").over(here)
    streamed = ranged.withColumn("new_doc", (before.isNull() | ~before["id"].eqNullSafe(F.col("row.id"))).cast("int"))
    salted = streamed.groupBy("h1", "h2", "salt").agg(F.sum("new_doc").alias("docs"), F.min(F.struct("row", "pos")).alias("first"))
    key = Window.partitionBy("h1", "h2")  # one row for each salt of the key
    found = salted.withColumns({"docs": F.sum("docs").over(key), "first": F.min("first").over(key)}).where(F.col("docs") >= min_docs)
    hit = keyed.join(found.drop("docs"), ["h1", "h2", "salt"])
    if keep_first:
        hit = hit.where(F.struct("row", "pos") != F.col("first"))
    return hit.groupBy("row", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits")
    )


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, columns: tuple[str, ...] = ()
) -> DataFrame:
    """Drop all lines whose key (at least `min_chars` code points) occurs in at least `min_docs` documents.

    With `keep_first` the first occurrence, by document and position, stays. Returns doc_id, the input `columns` asked
    for, n_lines, n_dropped, drop_bitmap (array of word number and 62 bits) and kept_text (other lines joined by \\n).

    A null or empty text is one empty line. Rows that share a doc_id count as one document for the number of
    documents, whatever their texts, and are told apart by their text; a null doc_id is an ordinary value, so all rows
    without an id are one document. An empty table gives an empty result. Other columns are ignored.
    """
    aside = {c: f"_in_{k}" for k, c in enumerate(columns)}
    base = docs.select(
        F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(a) for c, a in aside.items())
    )
    # A row is known by doc_id and a hash of its text; equal rows get equal bitmaps.
    row = F.struct(F.col("_id").alias("id"), F.xxhash64("text").alias("t"))
    rows = base.select(row.alias("row"), "text")
    marks = _marks(rows, min_docs, min_chars, keep_first)
    maps = marks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drop_bitmap"))
    maps = maps.select(F.col("row.id").alias("m_id"), F.col("row.t").alias("m_t"), "drop_bitmap")
    base = base.withColumn("_t", F.xxhash64("text"))
    joined = base.join(maps, base["_id"].eqNullSafe(maps["m_id"]) & (base["_t"] == maps["m_t"]), "left")
    joined = joined.withColumn("_lines", _lines(F.col("text")))
    dense = F.map_from_entries(F.coalesce(F.col("drop_bitmap"), F.array().cast("array<struct<word:int,bits:bigint>>")))
    last = F.floor((F.size("_lines") - 1) / BITS).cast("int")
    joined = joined.withColumn("_map", dense)
    joined = joined.withColumn(
        "_words", F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at("_map", w), F.lit(0).cast("long")))
    )
    kept = F.filter(
        F.col("_lines"),
        lambda x, i: F.getbit(F.get("_words", F.floor(i / BITS).cast("int")), F.pmod(i, F.lit(BITS))) == 0,
    )
    joined = joined.withColumn("_kept", F.when(F.col("drop_bitmap").isNull(), F.col("_lines")).otherwise(kept))
    return joined.select(
        F.col("_id").alias("doc_id"),
        *(F.col(a).alias(c) for c, a in aside.items()),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        "drop_bitmap",
        F.array_join("_kept", "\n").alias("kept_text"),
    )
