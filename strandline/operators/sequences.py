"""Order-dependent assignment and clustering, one group at a time."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.graph import checkpointed


def _listed(candidates: DataFrame) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("score"), "source")
    return candidates.select("target", "source", "score", F.row_number().over(order).alias("place"))


def _settled(lists: DataFrame, place: DataFrame) -> DataFrame:
    """Rounds of deferred acceptance over lists (target, source, score, place), from the places where the targets ask:
    those that hold a source in the end, with what they hold. A source keeps the first in order of the targets that ask; a
    refused one goes on to its next source that no earlier target holds, as those never come free for it; without one it
    has no place any more."""
    while True:
        asking = lists.join(place, ["target", "place"])
        kept = asking.groupBy("source").agg(F.min("target").alias("holder"))
        refused = checkpointed(asking.join(kept, "source").where(F.col("holder") != F.col("target")).select("target"))
        if refused.isEmpty():
            return asking
        open_ = lists.join(refused, "target").join(kept, "source", "left").where(F.col("holder").isNull() | (F.col("holder") > F.col("target")))
        moved = place.join(refused, "target", "left_anti").unionByName(open_.select("target", "place"))
        place = checkpointed(moved.groupBy("target").agg(F.min("place").alias("place")))


def greedy(candidates: DataFrame) -> DataFrame:
    """Of (target, source, score): targets in order take their best source that none before them took; of equal ones
    the smaller. Returns target, source, score.

    All sources rank the targets alike, so deferred acceptance ends there. A round is grouped minima and joins by target
    and source; no task holds more than the rows of one of them, combined before the shuffle."""
    lists = checkpointed(_listed(candidates))
    return _settled(lists, lists.select("target", "place").where("place = 1")).select("target", "source", "score")


def greedy_widened(best: Callable[[int, DataFrame | None], DataFrame], first: int = 4) -> DataFrame:
    """`greedy` over lists that grow as they are needed. best(k, targets) gives the k best sources, of equals the smaller,
    of some targets (target), or of all: target, source, score, the same ones first whatever k is. Only targets that a
    whole list of k has refused ask for 2k, and go on from there, as a refusal is never taken back; so candidates grow
    with the refusals and not with the square of the targets."""
    lists = checkpointed(_listed(best(first, None)))
    place = lists.select("target", "place").where("place = 1")
    limits = checkpointed(place.select("target", F.lit(first).alias("k")))
    while True:
        held = checkpointed(_settled(lists, place))
        waiting = checkpointed(limits.join(held, "target", "left_anti"))
        k = waiting.agg(F.min("k")).first()[0]  # those with the shortest lists ask first; null if none waits
        if k is None:
            return held.select("target", "source", "score")
        wider = waiting.where(F.col("k") == k).select("target")
        more = checkpointed(_listed(best(2 * k, wider)).where(F.col("place") > k))
        lists = checkpointed(lists.unionByName(more))
        known = more.where(F.col("place") == k + 1).select("target")  # others have no more sources
        limits = checkpointed(limits.join(wider, "target", "left_anti").unionByName(known.select("target", F.lit(2 * k).alias("k"))))
        place = held.select("target", "place").unionByName(known.select("target", F.lit(k + 1).alias("place")))


def matched_in_order(candidates: DataFrame, moved: float, low: float, margin: float) -> DataFrame:
    """Of (target, source, score, same): targets in order look at the sources that none before them took. With one of the
    same content they take it, the smallest; else the best by score, then by greater name, decides: from `moved` on they
    take it, unless a second one from `moved` on is nearer than `margin` (ambiguous: none is taken); from `low` on it is
    named and not taken. Returns target, source, score, match_type of the targets that have any of these.

    A target is decided in a round if it comes first of those that may take its best or its second source; the first
    target left always is, and targets without common sources do not wait for each other."""
    x = F.col("score")
    able = F.col("same") | (x >= moved)
    left, out = checkpointed(candidates.select("target", "source", "score", "same", able.alias("able"))), []
    order = Window.partitionBy("target").orderBy(F.desc("same"), F.when(F.col("same"), F.col("source")), F.desc("score"), F.desc("source"))
    while not left.isEmpty():
        first = left.where("able").groupBy("source").agg(F.min("target").alias("first"))
        top = left.join(first, "source", "left").withColumn("place", F.row_number().over(order)).where("place <= 2")
        blocked = F.coalesce(F.col("first") < F.col("target"), F.lit(False))
        waits = blocked & ((F.col("place") == 1) | F.col("able"))  # a second one below `moved` changes nothing
        row = F.struct("place", "source", "score", "same")
        both = top.groupBy("target").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.max(waits).alias("waits"))
        best, second = F.col("a.score"), F.when(F.col("b.place") == 2, F.col("b.score")).otherwise(0.0)
        close = (best >= moved) & (second >= moved) & (best - second < margin)
        kind = F.when(F.col("a.same"), "content_moved").when(close, "ambiguous").when(best >= moved, "content_moved").when(best >= low, "low_confidence")
        done = checkpointed(both.where("not waits").select("target", F.col("a.source").alias("source"), F.when(F.col("a.same"), 1.0).otherwise(best).alias("score"), kind.alias("match_type")))
        out.append(done)
        taken = done.where("match_type = 'content_moved'").select("source")
        left = checkpointed(left.join(done.select("target"), "target", "left_anti").join(taken, "source", "left_anti"))
    return reduce(DataFrame.unionByName, out).where("match_type is not null") if out else candidates.select("target", "source", "score", F.lit("").alias("match_type"))


def leaders(items: DataFrame, group: str, least: int) -> DataFrame:
    """Of (group, ord, tokens): items in order join the cluster that shares most tokens with them, if `least` or more
    (the earliest of equals), and add theirs to it; else they open one. Returns group, cluster, size, first."""
    def run(pdf):
        clusters: list[list] = []
        for r in pdf.sort_values("ord").itertuples(index=False):
            mine = set(r.tokens)
            best = max(range(len(clusters)), key=lambda k: (len(mine & clusters[k][0]), -k), default=None)
            if best is not None and len(mine & clusters[best][0]) >= least:
                clusters[best][0] |= mine
                clusters[best][1] += 1
            else:
                clusters.append([mine, 1, r.ord])
        key = pdf[group].iat[0] if len(pdf) else None
        return pd.DataFrame([(key, k, n, first) for k, (_, n, first) in enumerate(clusters)], columns=[group, "cluster", "size", "first"])

    return items.groupBy(group).applyInPandas(run, f"{group} long, cluster long, size long, first long")


# How many keywords, hints and references a contribution gathers, and how many hints when titles coincide.
KEYWORDS, HINTS, REFERENCES, TITLE_HINTS = 6, 5, 4, 4
MERGED = (
    "place int, id string, title string, section string, keywords array<string>, impl_hints array<string>, problem_solved string, "
    "baseline_difference string, evidence_refs array<string>, complexity int"
)


class _Kept:
    """Kept items in order, with the items that hold each keyword and each word of a title. Items grow, titles stay."""

    def __init__(self):
        self.items: list[dict] = []
        self._by_keyword: dict[str, set[int]] = defaultdict(set)
        self._by_word: dict[str, set[int]] = defaultdict(set)

    def add(self, item: dict) -> None:
        place = len(self.items)
        self.items.append(item)
        for w in item["keywords"]:
            self._by_keyword[w].add(place)
        for w in item["words"]:
            self._by_word[w].add(place)

    def first_like(self, item: dict, least: int) -> int | None:
        shared = Counter(k for w in set(item["keywords"]) for k in self._by_keyword.get(w, ()))
        shared.update(k for w in set(item["words"]) for k in self._by_word.get(w, ()))
        return min((k for k, n in shared.items() if n >= least), default=None)

    def absorb(self, place: int, item: dict) -> None:
        old = self.items[place]
        keywords = _united(old["keywords"], item["keywords"], KEYWORDS)
        for w in set(old["keywords"]) - set(keywords):
            self._by_keyword[w].discard(place)
        for w in keywords:
            self._by_keyword[w].add(place)
        self.items[place] = old | {
            "keywords": keywords,
            "impl_hints": _united(old["impl_hints"], item["impl_hints"], HINTS),
            "evidence_refs": _united(old["evidence_refs"], item["evidence_refs"], REFERENCES),
            "problem_solved": old["problem_solved"] or item["problem_solved"],
            "baseline_difference": old["baseline_difference"] or item["baseline_difference"],
            "complexity": max(old["complexity"] or 1, item["complexity"] or 1),
        }


def _united(a: list, b: list, most: int) -> list:
    return list(dict.fromkeys([*a, *b]))[:most]


def _by_title(items: list[dict]) -> list[dict]:
    """Items of one title, whatever its case, become one, which keeps only what all contributions have."""
    out: dict[str, dict] = {}
    for item in items:
        key = item["title"].lower()
        if key in out:
            old = out[key]
            out[key] = {"id": old["id"], "title": old["title"]} | {
                "section": old["section"] if old["section"] != "Abstract" else item["section"],
                "keywords": _united(old["keywords"], item["keywords"], KEYWORDS),
                "impl_hints": _united(old["impl_hints"], item["impl_hints"], TITLE_HINTS),
                "evidence_refs": [],
            }
        else:
            out[key] = item
    return list(out.values())


def merge_sets(primary: DataFrame, secondary: DataFrame, group: str, least: int = 2) -> DataFrame:
    """SEQ-04, SEQ-06: the contributions of each group. Rows: group (long), ord, id, title, words (the title's tokens),
    section, keywords, impl_hints, problem_solved, baseline_difference, evidence_refs, complexity; null lists are empty.

    Primary ones are kept in order of `ord`. Each secondary one is taken up by the first kept one with which it shares
    `least` keywords and title words, or is kept itself; a kept one gathers keywords, hints and references up to their
    limits, and the next are compared with what it has become. At the end equal titles become one. A group is a job, whose
    contributions are few; all of them meet in one task."""
    def rows(pdf):
        lists = ("words", "keywords", "impl_hints", "evidence_refs")
        items = pdf.sort_values(["ord", "id"]).to_dict("records")
        return [{k: (list(v) if k in lists and v is not None else [] if k in lists else None if v is None or v != v else v) for k, v in x.items()} for x in items]

    def run(key, first, second):
        kept = _Kept()
        for item in rows(first):
            kept.add(item)
        for item in rows(second):
            place = kept.first_like(item, least)
            kept.add(item) if place is None else kept.absorb(place, item)
        names = [c.split()[0] for c in MERGED.split(", ")[1:]]
        out = [(key[0], n, *(x.get(c) for c in names)) for n, x in enumerate(_by_title(kept.items), 1)]
        df = pd.DataFrame(out, columns=[group, "place", *names])
        return df.astype({"complexity": "Int32"})

    return primary.groupBy(group).cogroup(secondary.groupBy(group)).applyInPandas(run, f"{group} long, {MERGED}")
