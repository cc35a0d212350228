"""Line and character differences. The matching itself is procedural and runs in Arrow batches; parsing is native."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window


@F.pandas_udf(DoubleType())
def ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    """Similarity of two texts by matching character blocks; null if one is null."""
    def one(a, b):
        return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_from(old: pd.Series, new: pd.Series, least: pd.Series) -> pd.Series:
    """As `ratio`, but null below `least`: bounds by length and by letters are tried first, the matching after them."""
    def one(a, b, low):
        if a is None or b is None:
            return None
        m = difflib.SequenceMatcher(None, a, b)
        if m.real_quick_ratio() < low - 1e-12 or m.quick_ratio() < low - 1e-12:
            return None
        value = m.ratio()
        return value if value >= low - 1e-12 else None

    return pd.Series([one(*r) for r in zip(old, new, least)], dtype="float64")


@F.pandas_udf(StringType())
def unified(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff with three lines of context; a null side is an empty file."""
    def one(a, b):
        lines = difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "a", "b", n=3, lineterm="")
        return "\n".join(lines)

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)


def html(diff: Column) -> Column:
    """SNK-08: a diff as an HTML table, a row for each line with a class by its kind and the text escaped."""
    def row(line):
        text = line
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(char), F.lit(entity))
        kind = F.when(F.startswith(line, F.lit("@@")), "hunk").when(F.startswith(line, F.lit("+")), "add").when(F.startswith(line, F.lit("-")), "del").otherwise("same")
        return F.concat(F.lit('<tr class="'), kind, F.lit('"><td>'), text, F.lit("</td></tr>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(F.split(diff, "\n", -1), row), ""), F.lit("</table>"))


#: Fixed value: where a line ends, as Python's splitlines() has it.
_LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


_BLOCK = StructType([StructField("kind", StringType()), *(StructField(c, IntegerType()) for c in ("i1", "i2", "j1", "j2"))])


def lines(x: Column) -> Column:
    """The lines of a text; an end of line at the end begins no other, and an empty or null text has none."""
    cut = F.split(F.coalesce(x, F.lit("")), _LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


@F.pandas_udf(ArrayType(_BLOCK))
def changed_blocks(old: pd.Series, new: pd.Series) -> pd.Series:
    """Blocks of lines that the new side inserts or replaces, in order, as half-open ranges of both sides."""
    def one(a, b):
        found = difflib.SequenceMatcher(None, list(a), list(b)).get_opcodes()
        return [dict(zip(("kind", "i1", "i2", "j1", "j2"), o)) for o in found if o[0] in ("insert", "replace")]

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)


def code_anchors(pairs: DataFrame, most: int = 3, context: int = 3, most_lines: int = 24, head: int = 8) -> DataFrame:
    """Places of a file where it differs from its base. pairs: pair_id, path, base_path, old, new; the result: pair_id,
    place, patch_id, path, base_path, anchor_kind, start_line, end_line, original_start_line, original_end_line, snippet,
    original_snippet.

    Each inserted or replaced block shows the lines around it on both sides, `most_lines` at most. Blocks whose window is
    blank, or the same on both sides, do not count towards the first `most`. A file without any shows its first `head`
    lines as context; an empty file shows nothing. Line numbers begin at 1; those of the original are null where its
    window is blank."""
    from strandline.functions.scores import patch_id
    from strandline.functions.text import strip
    from strandline.operators.graph import checkpointed

    def window(side, start, end):
        first = F.greatest(start - context, F.lit(0))
        last = F.least(end + context, F.size(side))
        return first, F.slice(side, first + 1, F.least(last - first, F.lit(most_lines)))

    def filled(x):
        return F.nullif(strip(F.array_join(x, "\n")), F.lit(""))

    df = pairs.select("pair_id", "path", "base_path", lines(F.col("old")).alias("a"), lines(F.col("new")).alias("b"))
    df = checkpointed(df.withColumn("blocks", changed_blocks("a", "b")))  # read twice; the matching is the costly part
    block = df.select("*", F.posexplode("blocks").alias("n", "o"))
    at, now = window(F.col("b"), F.col("o.j1"), F.col("o.j2"))
    from_, was = window(F.col("a"), F.col("o.i1"), F.col("o.i2"))
    block = block.withColumns({"at": at, "now": now, "from": from_, "was": was})
    block = block.withColumns({"snippet": strip(F.array_join("now", "\n")), "original_snippet": filled(F.col("was"))})
    block = block.where((F.col("snippet") != "") & ~F.col("snippet").eqNullSafe(F.col("original_snippet")))
    order = Window.partitionBy("pair_id").orderBy("n")
    block = block.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    has = F.col("original_snippet").isNotNull()
    block = block.select(
        "pair_id", "path", "base_path", "place", F.col("o.kind").alias("kind"), "snippet", "original_snippet",
        (F.col("at") + 1).alias("start_line"), (F.col("at") + F.size("now")).alias("end_line"),
        F.when(has, F.col("from") + 1).alias("original_start_line"), F.when(has, F.col("from") + F.size("was")).alias("original_end_line"),
    )
    top, under = F.slice("b", 1, head), F.slice("a", 1, head)
    old_lines = F.size("a") > 0
    plain = df.join(block.select("pair_id").distinct(), "pair_id", "left_anti").where(F.size("b") > 0).select(
        "pair_id", "path", "base_path", F.lit(1).alias("place"), F.lit("context").alias("kind"), F.array_join(top, "\n").alias("snippet"), filled(under).alias("original_snippet"),
        F.lit(1).alias("start_line"), F.size(top).alias("end_line"), F.when(old_lines, 1).alias("original_start_line"),
        F.when(old_lines, F.least(F.size("a"), F.size(top))).alias("original_end_line"),
    )
    out = block.unionByName(plain)
    numbers = [F.coalesce(c, F.lit(0)).cast("string") for c in ("start_line", "end_line", "original_start_line", "original_end_line")]
    blank = F.lit("")
    ident = patch_id(F.col("path"), F.coalesce("base_path", blank), *numbers, F.col("snippet"), F.coalesce("original_snippet", blank), F.col("kind"))
    kind = F.when(F.col("kind") == "insert", "addition").when(F.col("kind") == "replace", "modification").otherwise(F.col("kind"))
    base = F.when(F.col("original_start_line").isNotNull(), F.coalesce("base_path", "path"))
    return out.select(
        "pair_id", "place", ident.alias("patch_id"), "path", base.alias("base_path"), kind.alias("anchor_kind"), "start_line", "end_line",
        "original_start_line", "original_end_line", "snippet", "original_snippet",
    )


def hunks(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """One row for each hunk of a diff text: its ranges and how many lines it adds and removes."""
    lines = diffs.select(key, F.posexplode(F.split(F.col(diff), "\n", -1)).alias("pos", "line"))
    head = F.startswith("line", F.lit("@@")).cast("long")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("hunk", F.sum(head).over(w)).where("hunk > 0")

    def number(pattern: str) -> Column:
        return F.max(F.when(F.startswith("line", F.lit("@@")), F.regexp_extract("line", pattern, 1).try_cast("int")))

    return lines.groupBy(key, "hunk").agg(
        number(r"-(\d+)").alias("old_start"),
        F.coalesce(number(r"-\d+,(\d+)"), F.lit(1)).alias("old_count"),
        number(r"\+(\d+)").alias("new_start"),
        F.coalesce(number(r"\+\d+,(\d+)"), F.lit(1)).alias("new_count"),
        F.count_if(F.startswith("line", F.lit("+"))).alias("added"),
        F.count_if(F.startswith("line", F.lit("-"))).alias("removed"),
    )


def changed_hunks(files: DataFrame) -> DataFrame:
    """DIF-04, HSH-09, STR-14, AGG-02: the hunks of each file (file_id, diff) with what they change: file_id, hunk,
    old_start, old_count, new_start, new_count, added, removed, changed_text (the added and removed lines in normal form),
    words (its distinct words) and hunk_id, a digest of place and content. Texts without a head have no hunks."""
    from strandline.functions import unicode as U
    from strandline.functions.scores import stable_digest, text_digest

    cut = files.select("file_id", F.posexplode(F.split("diff", "\n", -1)).alias("pos", "line"))
    head, sign = F.startswith("line", F.lit("@@")), F.substring("line", 1, 1)
    w = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("hunk", F.sum(head.cast("long")).over(w)).where("hunk > 0")
    changed = cut.where(~head & sign.isin("+", "-")).withColumn("line", U.normalize_line(F.substring("line", F.lit(2), F.length("line"))))
    row = F.struct("pos", "line")
    said = changed.groupBy("file_id", "hunk").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]).alias("changed"))
    ranges = hunks(files, "file_id", "diff").join(said, ["file_id", "hunk"], "left").withColumn("changed", F.coalesce("changed", F.array().cast("array<string>")))
    place = {"file_id": F.col("file_id").cast("string"), "old_start": F.col("old_start"), "old_len": F.col("old_count"), "new_start": F.col("new_start"), "new_len": F.col("new_count")}
    ident = stable_digest(24, **place, content_hash=text_digest(F.to_json("changed"), 24))
    out = ranges.withColumns({"hunk_id": ident, "changed_text": F.array_join("changed", "\n")}).drop("changed")
    words = F.filter(F.array_distinct(F.split(U.normalize_identifier("changed_text"), " ")), lambda x: x != "")
    return out.withColumn("words", words)


def whole_file(text: Column, sign: str) -> Column:
    """The diff of a file that is added (+) or deleted (-) as a whole; one hunk."""
    rows = lines(text)
    head = F.format_string("@@ -0,0 +1,%d @@" if sign == "+" else "@@ -1,%d +0,0 @@", F.size(rows))
    return F.concat_ws("\n", head, F.array_join(F.transform(rows, lambda x: F.concat(F.lit(sign), x)), "\n"))
