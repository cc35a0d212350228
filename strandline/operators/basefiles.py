"""Which file of a base tree each changed file comes from. Trees carry a job, so that many jobs run at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators.graph import checkpointed

# The points of a base file, and the least that make it one.
STEM_POINTS, PATH_POINTS, TAG_POINTS, IMPORT_POINTS, SYMBOL_POINTS, LEAST_POINTS = 6, 2, 3, 2, 1, 5
_SYMBOL = r"\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)"
_BASES = r"class\s+[A-Za-z_][A-Za-z0-9_]*\(([^)]*)\)"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, "([^/]+)/*$", 1), r"(?<=.)\.[^./]+$", ""))


def path_words(path: Column) -> Column:
    """STR-34: the parts of a path and its stem, of three characters or more; the suffix is compared by itself."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: F.length(p) >= 3)
    return F.array_except(F.array_union(parts, F.filter(F.array(stem(path)), lambda p: F.length(p) >= 3)), F.array(suffix(path)))


def import_words(code: Column) -> Column:
    """The last two parts of each imported name, lower-cased."""
    def last(name):
        parts = F.filter(F.split(name, r"\."), lambda p: p != "")
        return F.transform(F.slice(F.reverse(parts), 1, 2), F.lower)

    return F.array_distinct(F.flatten(F.transform(T.imports(code), last)))


def base_classes(code: Column) -> Column:
    """Plain names of the classes that others are derived from, without their module and type arguments."""
    def one(raw):
        name = F.element_at(F.split(T.strip(raw), r"\["), 1)
        return F.regexp_replace(name, r"^[^.]*\.", "")

    names = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(_BASES), F.lit(1)), lambda x: F.transform(F.split(x, ",", -1), one)))
    return F.array_distinct(F.filter(names, lambda n: n.rlike("^[A-Za-z_][A-Za-z0-9_]*$")))


def contained_words(texts: DataFrame, words: DataFrame, per_automaton: int = 20_000) -> DataFrame:
    """(job, path, word): the words (job, word) of a job that each of its texts (job, path, text) holds anywhere. One
    automaton finds all words of a job in one pass over a text; a job with more than `per_automaton` words has several."""
    words = words.where("word <> ''").distinct()
    size = words.groupBy("job").agg(F.ceil(F.count("*") / per_automaton).alias("k"))
    lists = words.join(size, "job").groupBy("job", F.pmod(F.xxhash64("word"), "k").alias("part")).agg(F.collect_list("word").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        built, automaton = None, None
        for batch in batches:
            found = []
            for job, part, path, text, mine in zip(*(batch.column(c).to_pylist() for c in ("job", "part", "path", "text")), batch.column("words")):
                if (job, part) != built:
                    built, automaton = (job, part), ahocorasick.Automaton()
                    for w in mine.as_py():
                        automaton.add_word(w, w)
                    automaton.make_automaton()
                found += [(job, path, w) for w in {w for _, w in automaton.iter(text)}]
            cells = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names=["job", "path", "word"])

    rows = texts.where("text is not null").repartition("job", "path").join(lists, "job").select(F.col("job").cast("string"), F.col("part").cast("long"), "path", "text", "words")
    return rows.sortWithinPartitions("job", "part").mapInArrow(run, "job string, path string, word string")


def best_by_features(mine: DataFrame, asked: DataFrame, theirs: DataFrame, rare: int = 16) -> DataFrame:
    """(job, file, suffix, score, path): for each file of `mine` (job, file, suffix, kind, word, points) the file of
    `theirs` (job, file, suffix, kind, word; its path begins at the 65th character) of its job and suffix, of any if it
    has none, with most points for shared features (kind, word); of equals the smallest path. Files that share none have
    no row. asked: how often (n) each feature (job, kind, word) is in `mine`; one that a file has twice counts twice.

    A feature that `rare` files at most have on one side is looked up, so that its pairs grow with the files. By the others,
    files of either side with the same ones are a class, and only classes meet. A file's best is the better of its class's
    best and of those it meets by rare features, which get the points of their classes added."""
    key = ["job", "kind", "word"]
    theirs = checkpointed(theirs.distinct())
    sizes = asked.join(theirs.groupBy(key).agg(F.count("*").alias("m")), key)
    sizes = checkpointed(sizes.select(*key, (F.least("n", "m") <= rare).alias("rare")))

    def classed(df, *points):
        x = F.struct("kind", "word", *points)
        df = df.join(sizes, key).groupBy("job", "file", "suffix").agg(
            F.array_sort(F.collect_list(F.when(~F.col("rare"), x))).alias("common"), F.collect_list(F.when(F.col("rare"), x)).alias("rare")
        )
        return checkpointed(df.withColumn("class", F.sha2(F.to_json(F.struct("job", "suffix", "common")), 256)))

    a, b = classed(mine, "points"), classed(theirs).withColumn("path", F.expr("substr(file, 65)"))
    fits = (F.col("suffix") == "") | (F.col("suffix") == F.col("their_suffix"))

    def rows(df, features):
        return df.select("*", F.explode(features).alias("x")).select("*", "x.*").drop("x", "common", "rare")

    def other(df, *columns):
        return df.select(*key, F.col("suffix").alias("their_suffix"), F.col("class").alias("their_class"), *columns)

    mine_classes = a.groupBy("job", "suffix", "class").agg(F.first("common").alias("common"))
    their_classes = b.groupBy("job", "suffix", "class").agg(F.first("common").alias("common"), F.min("path").alias("path"))
    met = rows(mine_classes, "common").join(other(rows(their_classes, "common"), "path"), key).where(fits)
    shared = checkpointed(met.groupBy("class", "their_class", "path").agg(F.sum("points").alias("score")))
    best = shared.groupBy("class").agg(F.min(F.struct((-F.col("score")).alias("score"), "path")).alias("by_class"))

    looked_up = rows(a, "rare").join(other(rows(b, "rare"), F.col("file").alias("theirs"), "path"), key).where(fits)
    looked_up = looked_up.groupBy("job", "file", "class", "their_class", "theirs", "path").agg(F.sum("points").alias("more"))
    looked_up = looked_up.join(shared.select("class", "their_class", "score"), ["class", "their_class"], "left")
    total = (-(F.col("more") + F.coalesce("score", F.lit(0)))).alias("score")
    singly = looked_up.groupBy("job", "file").agg(F.min(F.struct(total, "path")).alias("by_rare"))
    out = a.select("job", "file", "suffix", "class").join(best, "class", "left").join(singly, ["job", "file"], "left")
    out = out.withColumn("best", F.least("by_class", "by_rare")).where("best is not null")
    return out.select("job", "file", "suffix", (-F.col("best.score")).alias("score"), "best.path")


def base_matches(changed: DataFrame, base: DataFrame, least: int = LEAST_POINTS, rare: int = 16) -> DataFrame:
    """JON-06, MTH-14: (job, new_path, base_path), null if there is none. changed: job, path, text, tags; base: job,
    path, text; jobs are strings.

    The file's own path wins; then the first path that an imported module may have, in order of module; then, in order of
    name, the file with the only definition of a class that this one derives from. Else the file with most points decides,
    of equals the smallest path, among those of the same suffix (a file without one takes any): points for an equal stem,
    for each shared path word, and for each tag, imported name and defined symbol that the base's text holds. Base rows of
    one path and different texts are files of their own. `rare` is the one of `best_by_features`."""
    keys = ["job", "new_path"]
    new = changed.withColumnRenamed("path", "new_path").withColumn("text", F.coalesce("text", F.lit("")))
    low = base.select("job", F.col("path"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    places = base.select("job", "path").distinct()
    own = new.select("job", F.col("new_path")).join(places.withColumnRenamed("path", "new_path"), keys).withColumn("own", F.col("new_path"))

    paths = new.select(*keys, F.posexplode(T.import_paths(T.imports(F.col("text")))).alias("n", "path"))
    by_import = paths.join(places, ["job", "path"]).groupBy(keys).agg(F.min_by("path", "n").alias("by_import"))

    defined = base.select("job", "path", F.explode(F.regexp_extract_all("text", F.lit(_SYMBOL), F.lit(1))).alias("symbol"))
    only = defined.groupBy("job", "symbol").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    derived = new.select(*keys, F.explode(base_classes(F.col("text"))).alias("symbol"))
    by_class = derived.join(only, ["job", "symbol"]).groupBy(keys).agg(F.min_by("path", "symbol").alias("by_class"))

    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    imported, symbols = import_words(F.col("text")), F.transform(T.symbols(F.col("text")), F.lower)
    new = new.select(*keys, suffix(F.col("new_path")).alias("suffix"), tags.alias("tags"), imported.alias("imported"), F.array_distinct(symbols).alias("symbols"))

    def feature(kind, word, points=None):
        return F.struct(F.lit(kind).alias("kind"), word.alias("word"), *(() if points is None else (F.lit(points).alias("points"),)))

    def each(kind, words, points):
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: feature(kind, w, points))

    named = F.array_union(path_words(F.col("new_path")), F.array_union("tags", "imported"))
    features = F.concat(
        each("text", F.col("tags"), TAG_POINTS), each("text", F.col("imported"), IMPORT_POINTS), each("text", F.col("symbols"), SYMBOL_POINTS),
        each("path", named, PATH_POINTS), F.array(feature("stem", stem(F.col("new_path")), STEM_POINTS)),
    )
    mine = new.select(F.col("job"), F.col("new_path").alias("file"), "suffix", F.explode(features).alias("x")).select("job", "file", "suffix", "x.*")
    asked = checkpointed(mine.groupBy("job", "kind", "word").agg(F.count("*").alias("n")))

    # Base files of one path stay apart by the digest of their text, which goes before the path.
    low = low.withColumn("file", F.concat(F.sha2(F.col("text").cast("binary"), 256), "path"))
    of_path = F.concat(F.transform(path_words(F.col("path")), lambda w: feature("path", w)), F.array(feature("stem", stem(F.col("path")))))
    wanted = asked.where("kind = 'text'").select("job", "word")
    found = contained_words(low.select("job", F.col("file").alias("path"), "text"), wanted).select("job", F.col("path").alias("file"), F.lit("text").alias("kind"), "word")
    theirs = low.select("job", "file", F.explode(of_path).alias("x")).select("job", "file", "x.*").unionByName(found)
    theirs = theirs.withColumn("suffix", suffix(F.expr("substr(file, 65)")))

    best = best_by_features(mine, asked, theirs, rare).withColumn("score", F.col("score") + F.when(F.length("suffix") > 1, PATH_POINTS).otherwise(0))
    by_score = best.where(F.col("score") >= least).select("job", F.col("file").alias("new_path"), F.col("path").alias("by_score"))
    out = changed.select("job", F.col("path").alias("new_path"))
    for part in (own, by_import, by_class, by_score):
        out = out.join(part, keys, "left")
    return out.select(*keys, F.coalesce("own", "by_import", "by_class", "by_score").alias("base_path"))
