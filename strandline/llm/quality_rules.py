"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The measures are array expressions over the words and lines of a text, so a document is judged inside its own row:
no shuffle, no Python, and memory bounded by one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WHITE, words_col

# Very frequent function words by language, as they appear inside sentences.
STOP_WORDS = {
    "en": "the of and to a in that is was he for it with as his on be at by had not are but from or have an they which this",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec ce il sont",
    "de": "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le o este sí porque esta entre cuando muy sin sobre",
}


def stop_forms(lang: str) -> list[str]:
    """A language's stop words as running text has them: in lower case, or capitalised at the start of a sentence."""
    words = STOP_WORDS[lang].split()
    return sorted({*words, *(w[0].upper() + w[1:] for w in words)})


SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`measure` must lie in [low, high]; a bound that is None is open."""

    measure: str
    low: float | None
    high: float | None


# The threshold table. Measures are defined in `_measures`.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.04, None),
    Rule("dup_line_share", None, 0.3),
    Rule("mean_line_words", 3.0, None),  # pages of single words; the shortest clean ones have 4 words a line
)
BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30


def _counted(docs: DataFrame) -> DataFrame:
    """Adds the counted measures to the rows; intermediate arrays live in columns so that each is built once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = docs.withColumns({"_text": text, "_words": words_col(text), "_lines": lines})
    df = df.withColumns({"_n": F.size("_words"), "_hash": F.transform("_words", lambda w: F.xxhash64(w))})
    window = F.when(
        F.col("_n") >= REPEAT_WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.col("_n") - REPEAT_WINDOW),
            lambda i: F.struct(F.xxhash64(F.slice("_hash", i + 1, F.lit(REPEAT_WINDOW))).alias("h"), i.alias("i")),
        ),
    )
    df = df.withColumn("_sorted", F.sort_array(window))
    again = F.filter(
        F.col("_sorted"),
        lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]),
    )
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(
            F.col("_at"),
            lambda i, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("_at", k + 1) - i, F.lit(REPEAT_WINDOW))),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    stripped = F.translate(F.col("_text"), WHITE, "")

    def is_stop(w):
        out = F.lit(False)
        for lang in STOP_WORDS:  # only the row's own language looks at the word
            out = out | ((F.col("_lang") == lang) & F.btrim(w, F.lit(".,;:")).isin(*stop_forms(lang)))
        return out

    stops = F.when(F.col("_lang").isin(*STOP_WORDS), F.size(F.filter("_words", is_stop)))
    return df.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(stripped).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_stop_words": stops.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    )


def _measures() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_share": F.col("n_stop_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "mean_line_words": F.col("n_words") / lines,
    }


def compile_rules(rules=RULES) -> Column:
    """The conjunction of the table's rules as one boolean expression. A rule whose measure is null, as stop words are
    for a language without a list, holds."""
    measures, out = _measures(), F.lit(True)
    for r in rules:
        for bound, compare in ((r.low, Column.__ge__), (r.high, Column.__le__)):
            if bound is not None:
                out = out & F.coalesce(compare(measures[r.measure], bound), F.lit(True))
    return out


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("_lang")


NEW = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_lines base_failed kept".split()


def quality_rules(docs: DataFrame, rules=RULES, keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures and verdict of each row: `base_failed`, and `kept` (the base and all rules hold).

    Null and empty texts have no words and fail the base. Stop words are those of the row's `lang`; with another, a null
    or no lang n_stop_words is null and its rule is skipped. Every input row gives one row, repeated rows included; a null
    doc_id stays null. Input columns other than text and `keep_columns` are dropped first, so their names never clash.
    """
    aside = {c: f"_in_{k}" for k, c in enumerate(keep_columns)}
    df = docs.select(F.col("text"), _lang(docs), *(F.col(c).alias(a) for c, a in aside.items()))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    df = _counted(df).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    return df.select(*(F.col(a).alias(c) for c, a in aside.items()), *NEW)


def quality_filter(docs: DataFrame, rules=RULES) -> DataFrame:
    """The input rows, with their own columns, that the rules keep."""
    aside = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    df = docs.select(F.col("text").alias("text"), _lang(docs), *(F.col(c).alias(a) for c, a in aside.items()))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    # A filter would be pushed below the measures by writing each out where it is used, nested many times over; it is
    # not pushed below a projection with a row number.
    df = _counted(df).withColumn("_row", F.monotonically_increasing_id())
    return df.where(~failed & compile_rules(rules) & (F.col("_row") >= 0)).select(*(F.col(a).alias(c) for c, a in aside.items()))
