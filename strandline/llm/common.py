"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes: the six ASCII white-space bytes never occur inside
a multi-byte character, so words `[^\\x20\\x09-\\x0D]+` can be cut on bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.graph import checkpoint_folder
from strandline.operators.graph import checkpointed as cut  # noqa: F401

WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]+"

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the checkpoint folder: for frames that are large and read column-wise."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_col(text):
    """Native array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(F.split(trimmed, WHITE_RE), F.array().cast("array<string>"))
    )


def n_words_col(text):
    return F.size(words_col(text)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 20)
        p = np.full(size, _MULT, dtype=np.uint64)
        q = np.full(size, _MULT_INV, dtype=np.uint64)
        p[0] = q[0] = 1
        _POW["p"], _POW["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, flattened in order, and the number of words of each text."""
    out, counts, i = [], np.zeros(len(texts), dtype=np.int64), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < chunk):
            size += len(texts[j]) + 1
            j += 1
        h, n = _chunk_hashes(texts[i:j])
        out.append(h)
        counts[i:j] = n
        i = j
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def _chunk_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    white = _IS_WHITE[a]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    p, q = _powers(len(a))
    c = np.empty(len(a) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(_BYTE[a] * p[: len(a)], out=c[1:])
    h = (c[ends] - c[starts]) * q[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    edges = np.cumsum([1] + [len(t) + 1 for t in texts])
    at = np.searchsorted(starts, edges)
    return h, np.diff(at)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i : i + n] for each i, by doubling; len(h) - n + 1 values (none if too few)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, out_len, cur, cur_len = None, 0, h, 1
    while n:
        if n & 1:
            if out is None:
                out, out_len = cur, cur_len
            else:
                m = len(h) - out_len - cur_len + 1
                out = mix64(out[:m] * np.uint64(0x9FB21C651E98DF25) + cur[out_len : out_len + m] + np.uint64(1))
                out_len += cur_len
        n >>= 1
        if n:
            m = len(h) - 2 * cur_len + 1
            cur = mix64(cur[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + cur[cur_len : cur_len + m] + np.uint64(2))
            cur_len *= 2
    return out


def window_starts(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of n words that lie inside one text: flat start, text number, position in the text."""
    k = np.maximum(counts - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), k)
    before = np.cumsum(k) - k
    pos = np.arange(int(k.sum())) - before[doc]
    offset = np.cumsum(counts) - counts
    return offset[doc] + pos, doc, pos


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, most similar bytes together, so that a block compressor shrinks small values."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def encode_all(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def doc_groups(docs: DataFrame, per_group: int = 1024) -> tuple[DataFrame, int]:
    """(grp, doc_id, text) with rows dealt by a hash of doc_id into groups of about per_group documents; the rows of a
    doc_id stay together. Rows without doc_id get none of the operator's work and are left out here."""
    n = docs.count()
    groups = max(16, -(-n // per_group))
    out = docs.where(F.col("doc_id").isNotNull()).select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).cast("int").alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return out, n


def text_chunks(batches, size: int):
    """(keys, texts) of about `size` bytes, or of one longer text, from Arrow batches of a key and a text's bytes. Only
    the rows of a chunk are Python objects."""
    import pyarrow.compute as pc

    keys, texts, held = [], [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + size - held)) + 1, batch.num_rows)
            keys += batch.column(0).slice(at, stop - at).to_pylist()
            texts += batch.column(1).slice(at, stop - at).to_pylist()
            held += int(ends[stop - 1]) - before
            if held >= size:
                yield keys, texts
                keys, texts, held = [], [], 0
            at = stop
    if keys:
        yield keys, texts


def one_row(schema, values: dict):
    """An Arrow batch of one row; list cells take an array of their values."""
    import pyarrow as pa

    def cell(field):
        v = values[field.name]
        if not pa.types.is_list(field.type):
            return pa.array([v], field.type)
        inner = v if isinstance(v, pa.Array) else pa.array(v, field.type.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)

    return pa.RecordBatch.from_arrays([cell(f) for f in schema], schema=schema)
