"""Token counts by dynamic programming on a trie.

The distinct pre-tokens of a batch go into a trie; the unigram forward score of each prefix is computed once for all
pre-tokens that share it, level by level, and the count stored at the terminal node serves every occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.unigram import LONG, SPACE, Lattice, Vocabulary, pretokens, seam_parts, spaced
from strandline.session import ship

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def batches(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `chars` characters, so that memory follows neither the rows nor their number."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def split_batch(texts: list[str | None], vocab: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the number of each occurrence in order, how many each text has, and how many before long
    ones were cut at their seams."""
    if any(t and SPACE in t for t in texts):
        words, flat, sizes = _number([pretokens(t) for t in texts])
    else:
        pieces = pc.split_pattern(pa.array([spaced(t) if t else "" for t in texts], pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        words, flat = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
        if "" in words:  # between two spaces, or a text without pre-tokens
            real = flat != words.index("")
            sizes, flat = _per_text(real, sizes), flat[real]
            words[words.index("")] = "\n"  # keeps the numbers of the others; none uses it
    return *_at_seams(words, flat, sizes, vocab), sizes


def _per_text(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of each text's entries."""
    sums, ends = np.r_[0, np.cumsum(x)], np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def _number(lists: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return list(number), np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum())), sizes


def _at_seams(words: list[str], flat: np.ndarray, sizes: np.ndarray, vocab: Vocabulary):
    """The same with each long pre-token replaced by its parts."""
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if not long:
        return words, flat, sizes
    number, n_parts = {w: i for i, w in enumerate(words)}, np.ones(len(words), np.int64)
    cut = dict(zip(long, seam_parts([words[i] for i in long], vocab)))
    for i, parts in cut.items():
        n_parts[i] = len(parts)
    begin = np.cumsum(n_parts) - n_parts
    table = np.repeat(np.arange(len(words)), n_parts)
    for i, parts in cut.items():
        table[begin[i] : begin[i] + len(parts)] = [number.setdefault(w, len(number)) for w in parts]
    out = list(number)
    for i, parts in cut.items():
        if len(parts) > 1:
            out[i] = "\n"  # none uses it any more
    n = n_parts[flat]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return out, table[np.repeat(begin[flat], n) + inside], _per_text(n, sizes)


def distinct_bound(texts: list[str | None], words: list[str], most: int) -> bool:
    """Whether the distinct pre-tokens of several texts are too many characters for one trie (text without spaces)."""
    return len(texts) > 1 and sum(map(len, words)) > most


def count_texts(texts: list[str | None], vocab: Vocabulary, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of each text. A trie holds about `most` characters, or one longer text."""
    words, flat, sizes, whole = split_batch(texts, vocab)
    if distinct_bound(texts, words, most):
        half = len(texts) // 2
        return tuple(np.concatenate(x) for x in zip(count_texts(texts[:half], vocab, most), count_texts(texts[half:], vocab, most)))
    lattice = Lattice(words, vocab)
    per_word = lattice.best_counts()[lattice.terminal]
    return _per_text(per_word[flat], sizes), whole


def token_counts(docs: DataFrame, vocabulary: str = PIECES, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of each row under the unigram model's best segmentation of the whole text.

    Null and empty texts have 0 tokens. Each input row gives one row, repeated rows and null doc_ids included; other
    columns are ignored. No shuffle: a task holds one batch of about `batch_chars` characters, or one longer text.
    """
    ship(docs.sparkSession)
    vocab = Vocabulary.from_file(vocabulary)

    def run(frames):
        for pdf in frames:
            texts, n, k = pdf["text"].tolist(), [], []
            for a, b in batches(texts, batch_chars):
                x, y = count_texts(texts[a:b], vocab)
                n.append(x)
                k.append(y)
            none = np.empty(0, np.int64)
            out = pd.DataFrame({"doc_id": pdf["doc_id"].array, "n_tokens": np.concatenate([none, *n]), "n_pretokens": np.concatenate([none, *k])})
            yield out

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = source.mapInPandas(run, "doc_id string, n_tokens long, n_pretokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
