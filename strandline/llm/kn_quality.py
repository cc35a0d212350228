"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of character 4-grams.

The model is trained on the documents labelled as trusted, all of them but a fold held out for the thresholds. Counts
are tables keyed by n-gram: the discounted probability of each distinct 4-gram of the corpus comes from joins of the
count tables order by order, each dealt by its n-gram. No table is held by a task or the driver.

Documents are dealt into groups once, with their text compressed. A group sends its distinct 4-grams, with their counts
in trusted documents, and gets their log-probabilities back; with these it scores its documents. So what moves are
distinct n-grams of groups, not the occurrences, and a frequent n-gram is one row for each group.

A document is kept if its perplexity, shrunk towards the mean for short texts, is at most its language's quantile of
the held-out trusted documents, which is drawn towards the quantile over all languages the fewer there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, encode_all, written
from strandline.llm.token_counts import batches
from strandline.session import ship

BEGIN, END = "\x02", "\x03"
GRAMS = "grp int, gram string, c long"
SCORES = "doc_id string, lang string, held boolean, n_grams long, log_loss double"
SALTS = 32
PRIOR = 40  # characters of mean held-out loss that are added to each text, as the loss of a short text says little
DENSE = 1 << 25
PRIOR_HELD = 50  # held-out documents that the overall threshold counts for beside a language's own


def _ids(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Small consecutive numbers of the values, and the values by number."""
    if size > DENSE:
        values, number = np.unique(x, return_inverse=True)
        return number, values
    flag = np.zeros(size, bool)
    flag[x] = True
    values = np.flatnonzero(flag)
    table = np.zeros(size, np.int64)
    table[values] = np.arange(len(values))
    return table[x], values


def four_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 4-grams as rows of code points, the number of each occurrence, and where each text's occurrences end."""
    joined = "".join(f"{BEGIN}{BEGIN}{BEGIN}{t}{END}" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter((len(t) + 4 for t in texts), np.int64, len(texts))
    a, alphabet = _ids(cp, 0x110000)
    n = len(alphabet)
    two, pairs = _ids(a[:-1] * n + a[1:], n * n)
    three, triples = _ids(two[:-1] * n + a[2:], len(pairs) * n)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(cp), bool)  # windows that begin in the last three places run into the next text
    for k in (1, 2, 3):
        inside[first + lengths - k] = False
    begin = np.flatnonzero(inside)
    gram, values = _ids(three[begin] * n + a[begin + 3], len(triples) * n)
    triple = triples[values // n]
    pair = pairs[triple // n]
    chars = np.stack([alphabet[pair // n], alphabet[pair % n], alphabet[triple % n], alphabet[values % n]], axis=1)
    return chars, gram, np.cumsum(lengths - 3)


def _strings(chars: np.ndarray) -> list[str]:
    s = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [s[i : i + 4] for i in range(0, len(s), 4)]


def _group_count(pdf, labels):
    """Distinct 4-grams of a group of documents, with their counts in training documents."""
    counts: dict[str, int] = {}
    trusted = set(labels["doc_id"]) if len(labels) else set()
    train = pdf["doc_id"].isin(trusted).to_numpy() & pdf["z"].notna().to_numpy() & ~pdf["held"].fillna(False).to_numpy(bool)
    texts = _texts(pdf)
    for a, b in batches(texts, 2_000_000):
        chars, gram, ends = four_grams(texts[a:b])
        weight = np.repeat(train[a:b], np.diff(np.r_[0, ends]))
        found = np.bincount(gram, weights=weight, minlength=len(chars)).astype(np.int64)
        for s, c in zip(_strings(chars), found.tolist()):
            counts[s] = counts.get(s, 0) + c
    grp = int(pdf["grp"].iat[0]) if len(pdf) else 0
    grams = sorted(counts)  # so that the table of them is written small
    return pd.DataFrame({"grp": grp, "gram": pd.Series(grams, dtype=object), "c": pd.Series(map(counts.get, grams), dtype="int64")})


def _texts(pdf) -> list[str]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return ["" if z is None else unpack(z).decode("utf-8", "surrogatepass") for z in pdf["z"]]


def _group_score(pdf, told):
    if not len(pdf):
        return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
    logp = dict(zip(told["gram"], told["logp"]))
    texts, n, loss = _texts(pdf), [], []
    for a, b in batches(texts, 2_000_000):
        chars, gram, ends = four_grams(texts[a:b])
        table = np.array([logp[s] for s in _strings(chars)])
        sums = np.r_[0.0, np.cumsum(table[gram])]
        sizes = np.diff(np.r_[0, ends])
        n.append(sizes)
        loss.append(-(sums[ends] - sums[ends - sizes]) / sizes)
    return pdf[["doc_id", "lang", "held"]].astype(object).assign(n_grams=np.concatenate(n), log_loss=np.concatenate(loss))


def _pack(frames):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for pdf in frames:
        z = pd.Series([pack(x) if x else None for x in encode_all(pdf["text"])], dtype=object)
        yield pdf[["grp", "doc_id", "lang", "held"]].astype({"doc_id": object, "lang": object}).assign(z=z)


def _discounts(counts: DataFrame) -> dict[int, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times (four numbers)."""
    n = counts.where("c > 0 and c < 5").groupBy("c").count().collect()
    n = {r["c"]: r["count"] for r in n}
    n1, n2, n3, n4 = (max(n.get(k, 0), 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and y else 0.5
        out.append(min(max(d, 0.05), float(k)))
    return dict(zip((1, 2, 3), out))


def _discount(c: Column, d: dict[int, float]) -> Column:
    return F.when(c <= 0, 0.0).when(c == 1, d[1]).when(c == 2, d[2]).otherwise(d[3])


def _order(wanted: DataFrame, counts: DataFrame, n: int, lower: DataFrame | None, uniform: Column) -> DataFrame:
    """(gram, p) of each wanted n-gram. counts: (gram, c), lower: (gram, p) of all wanted n-grams' last n - 1 characters."""
    d = _discounts(counts)
    seen = counts.where("c > 0")
    sums = F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d)).alias("taken")
    df = wanted.join(seen, "gram", "left")
    if n > 1:
        context = F.substring("gram", 1, n - 1)
        df = df.withColumn("ctx", context).join(seen.groupBy(context.alias("ctx")).agg(*sums), "ctx", "left")
    else:  # one context, the empty one: two numbers
        one = seen.agg(*sums).first()
        df = df.withColumns({k: F.lit(one[k]).cast("double") for k in ("total", "taken")})
    if lower is not None:
        below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
        df = df.withColumn("suffix", F.substring("gram", 2, n - 1)).join(below, "suffix")
    else:
        df = df.withColumn("below", uniform)
    c = F.coalesce("c", F.lit(0))
    own = F.greatest(c - _discount(c, d), F.lit(0.0)) / F.col("total") + F.col("taken") / F.col("total") * F.col("below")
    return df.select("gram", F.coalesce(own, "below").alias("p"))


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, logp) of each distinct 4-gram, from (gram, c): interpolated modified Kneser-Ney, order by order."""
    counts = {4: grams}
    wanted = {4: grams.select("gram")}
    for n in (3, 2, 1):
        cut_off = F.substring("gram", 2, n)
        counts[n] = counts[n + 1].where("c > 0").groupBy(cut_off.alias("gram")).agg(F.count("*").alias("c"))
        wanted[n] = wanted[n + 1].select(cut_off.alias("gram")).distinct()
    counts[3], wanted[3] = cut(counts[3]), cut(wanted[3])
    uniform = F.lit(1.0 / (wanted[1].count() + 1))
    p = None
    for n in (1, 2, 3, 4):
        p = _order(wanted[n], counts[n], n, p, uniform)
    return p.select("gram", F.log("p").alias("logp"))


def kn_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, fold: int = 5, per_group: int = 2048) -> DataFrame:
    """doc_id, n_grams, perplexity, shrunk_perplexity, threshold and kept for each row. `labels` has doc_id and quality; a document is
    trusted if all its labels say 1. One in `fold` trusted documents, by a hash, sets thresholds instead of training.

    A language's threshold is the mean of its own quantile, weighted by its n held-out documents, and the quantile over
    all languages, weighted by PRIOR_HELD, at every n; without any held-out document, or without training text, all
    texts are kept. Null and empty texts have a null perplexity and are not kept. Repeated
    rows give repeated results; rows with a null doc_id are scored and never trusted. Other columns are ignored; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    groups = max(12, -(-docs.count() // per_group))
    id_text = F.col("doc_id").cast("string")

    def grp(key):
        return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("grp")

    source = docs.select(
        grp(F.coalesce(id_text, F.col("text").cast("string"), F.lit(""))),
        id_text.alias("doc_id"),
        (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"),
        (F.pmod(F.xxhash64(id_text, F.lit(3)), F.lit(fold)) == 0).alias("held"),
        F.col("text").cast("string").alias("text"),
    )
    packed = source.mapInPandas(_pack, "grp int, doc_id string, lang string, held boolean, z binary")
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id"))
    trusted = trusted.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1")
    trusted = trusted.select(grp(F.col("doc_id")), "doc_id")
    by_group, trusted_by_group = packed.groupBy("grp"), trusted.groupBy("grp")
    asked = written(by_group.cogroup(trusted_by_group).applyInPandas(_group_count, GRAMS))
    scored = probabilities(cut(asked.groupBy("gram").agg(F.sum("c").alias("c"))))
    told = asked.join(scored, "gram").select("grp", "gram", "logp")
    out = by_group.cogroup(told.groupBy("grp")).applyInPandas(_group_score, SCORES)
    out = out.join(trusted.select("doc_id", F.lit(True).alias("trusted")), "doc_id", "left")
    out = cut(out.withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    real = F.col("n_grams") > 1
    held = out.where(real & F.col("trusted") & F.col("held"))
    mean = F.lit(held.agg(F.sum(F.col("log_loss") * F.col("n_grams")) / F.sum("n_grams")).first()[0]).cast("double")
    shrunk = (F.col("log_loss") * F.col("n_grams") + F.coalesce(mean, F.lit(0.0)) * PRIOR) / (F.col("n_grams") + PRIOR)
    out, held = out.withColumn("score", shrunk), held.withColumn("score", shrunk)
    limit = F.percentile_approx("score", quantile, 10000).alias("limit")
    overall = F.lit(held.agg(limit).first()["limit"]).cast("double")  # one number
    key = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n"))
    by_lang = held.groupBy(key.alias("key")).agg(limit, F.count("*").alias("n"))
    by_lang = by_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = out.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = out.join(by_lang, ["key", "salt"], "left")
    at = F.coalesce((F.col("limit") * F.col("n") + overall * PRIOR_HELD) / (F.col("n") + PRIOR_HELD), overall)
    return out.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("n_grams"),
        F.when(real, F.exp("log_loss")).alias("perplexity"),
        F.when(real, F.exp("score")).alias("shrunk_perplexity"),
        F.exp(at).alias("threshold"),
        (real & F.coalesce(F.col("score") <= at, F.lit(True))).alias("kept"),
    )
