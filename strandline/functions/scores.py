"""Scores, digests, dates and array helpers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set's size; 0 if one is empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def recall(a: Column, b: Column) -> Column:
    """Shared elements over the second set's size; 0 if one is empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(b))


def python_round(x: Column, digits: int = 2) -> Column:
    """Rounding of the exact binary value, as Python's round() does; round() and bround() work on the decimal text."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def clamp_linear(base: float, slope: float, x: Column, cap: float) -> Column:
    return python_round(F.least(F.lit(base) + slope * x, F.lit(cap)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def significance(changed_lines: Column, linked: Column) -> Column:
    return F.when((linked > 0) | (changed_lines >= 50), "high").when(changed_lines >= 10, "medium").otherwise("low")


def significance_rank(s: Column) -> Column:
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def ranges_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed ranges; a start of 0 or less never overlaps."""
    return (a_start > 0) & (b_start > 0) & (a_start <= b_end) & (b_start <= a_end)


def bounded_distinct(a: Column, b: Column, n: int) -> Column:
    return F.slice(F.array_distinct(F.concat(a, b)), 1, n)


def symmetric_match(a: Column, stem_a: Column, b: Column, stem_b: Column) -> Column:
    """SET-05: what two sets share, and what each shares with the other's stem, sorted."""
    own = F.array_union(F.array_intersect(a, F.array(stem_b)), F.array_intersect(F.array(stem_a), b))
    return F.array_sort(F.array_union(F.array_intersect(a, b), own))


def first_match(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def patch_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12)


def text_digest(x: Column, n: int = 24) -> Column:
    return F.left(F.sha2(x.cast("binary"), 256), F.lit(n))


def stable_digest(n: int = 24, **fields: Column) -> Column:
    """Digest of canonical JSON: keys sorted, compact, non-ASCII kept."""
    return text_digest(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"}), n)


def month_of_id(x: Column) -> Column:
    """First of the month that a YYMM prefix names; null if there is none."""
    yy, mm = F.substring(x, 1, 2).try_cast("int"), F.substring(x, 3, 2).try_cast("int")
    return F.when(mm.between(1, 12) & yy.isNotNull(), F.make_date(2000 + yy, F.when(mm.between(1, 12), mm), F.lit(1)))


def weak_mapping(comparable: Column, anchors: Column, snippet: Column, formula: Column, coverage: Column) -> Column:
    """Ordered rules: the first that applies decides."""
    return (
        F.when(comparable > 0, False)
        .when((anchors == 0) & (snippet <= 0) & (formula <= 0), True)
        .when(coverage >= 0.25, False)
        .when((snippet >= 0.2) | (formula >= 0.2), False)
        .when(anchors > 0, False)
        .otherwise(True)
    )


def comparable_anchor(original: Column, snippet: Column) -> Column:
    from strandline.functions.text import strip

    return (strip(original) != "") & (strip(snippet) != "") & (strip(original) != strip(snippet))
