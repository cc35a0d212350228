"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.alignment import align_tokens
from strandline.llm.chat_format import PART, chat_format, read_back, unescape
from strandline.llm.collocations import collocations
from strandline.llm.html_extract import extract_pages
from strandline.llm.kn_quality import kn_quality
from strandline.llm.line_dedup import line_dedup
from strandline.llm.mixing import mix_sources
from strandline.llm.near_dedup import near_components
from strandline.llm.quality_rules import RULES, STOP_WORDS, quality_rules, stop_forms
from strandline.llm.sp_sampling import sample_digest
from strandline.llm.substring_dedup import substring_dedup
from strandline.llm.token_counts import token_counts
from strandline.llm.topk_search import quantised, top_k


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 20 words in every document; see `substring_dedup`."""
    docs = _read(spark, sf_dir, "documents")
    return substring_dedup(docs, window=20, want_text=False).drop("kept_text", "repeats")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)
), late AS (
  SELECT doc_id, s, d0, s0 FROM (
    SELECT doc_id, s, first_value(doc_id) OVER w AS d0, first_value(s) OVER w AS s0, row_number() OVER w AS r
    FROM win WINDOW w AS (PARTITION BY k ORDER BY doc_id, s)) WHERE r > 1
), runs AS (
  SELECT doc_id, count(*) + 19 AS n FROM (
    SELECT doc_id, d0, s0 - s AS shift, s - row_number() OVER (PARTITION BY doc_id, d0, s0 - s ORDER BY s) AS island FROM late)
  GROUP BY doc_id, d0, shift, island
), found AS (
  SELECT doc_id, count(*) AS n_repeats, max(n) AS longest_repeat FROM runs GROUP BY doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(generate_series(s, s + 19)) AS p FROM late) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws
    ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256,
  CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats, CAST(coalesce(longest_repeat, 0) AS BIGINT) AS longest_repeat
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN found USING (doc_id)
"""



def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document; see `quality_rules`."""
    return quality_rules(_read(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    measure = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_share": "n_stop_words / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "mean_line_words": "n_words / greatest(n_lines, 1)",
    }
    bounds = [(r.measure, op, b) for r in RULES for op, b in ((">=", r.low), ("<=", r.high)) if b is not None]
    return " AND ".join(f"coalesce({measure[m]} {op} {b!r}::DOUBLE, true)" for m, op, b in bounds)


def _stops_sql() -> str:
    lists = {lang: ", ".join(f"'{w}'" for w in stop_forms(lang)) for lang in STOP_WORDS}
    return "CASE lang " + " ".join(f"WHEN '{lang}' THEN [{words}]" for lang, words in lists.items()) + " END"


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, STOPS AS stops,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 7), ' ') AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS s FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + 7)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN stops IS NOT NULL THEN CAST(len(list_filter(ws, lambda x: list_contains(stops, trim(x, '.,;:')))) AS BIGINT) END AS n_stop_words,
    CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND RULES AS kept
FROM m
""".replace("STOPS", _stops_sql()).replace("RULES", _rules_sql())


CONTROL = "<|im_end|><|im_start|>assistant ok"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, and conversation -1, whose texts are control strings."""
    own = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL}'), (-1L, 1L, 'assistant', '{CONTROL}') AS v(conv_id, turn, role, text)"
    )
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, formatted and read back; see `chat_format`."""
    df = chat_format(_messages(spark, sf_dir)).withColumn("turns", read_back(F.col("formatted")))
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    def piece(x):
        return unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"].cast("int")))

    loss = F.array_join(F.transform("loss_spans", piece), "")
    df = df.withColumns({"_all": all_turns, "_loss": loss})
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("_all").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', 'CONTROL' UNION ALL SELECT -1, 1, 'assistant', 'CONTROL'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS l,
    sum(length('<|im_start|>' || replace(regexp_replace(role, '<(!*)\|', '<!\1|', 'g'), chr(10), '<|nl|>') || chr(10)
      || regexp_replace(text, '<(!*)\|', '<!\1|', 'g') || '<|im_end|>' || chr(10))) AS f
  FROM c GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(a) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars,
  sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars
FROM g
""".replace("CONTROL", CONTROL)


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, and one whose texts hold control strings, with typed parts: each turn is its text in two text parts and an image part, and an audio or
    document part behind every third turn."""
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.col("turn")

    def part(kind, body=None, ref=None, tokens=None):
        null = F.lit(None)
        cells = (F.lit(kind), null if body is None else body, null if ref is None else ref, null if tokens is None else tokens)
        return F.struct(*(c.cast(t).alias(n) for c, n, t in zip(cells, ("type", "text", "ref", "tokens"), ("string", "string", "string", "long"))))

    def ref(kind):
        return F.concat(F.lit(f"{kind}/"), F.col("conv_id"), F.lit("/"), turn)

    head, tail = part("text", F.substring(text, 1, 10)), part("text", F.expr("substring(coalesce(text, ''), 11)"))
    kind = F.when(turn % 2 == 0, "audio").otherwise("document")
    more = F.when(turn % 3 == 2, F.array(part("", ref=ref("file")).withField("type", kind))).otherwise(F.array().cast(f"array<{PART}>"))
    messages = _messages(spark, sf_dir).select(
        "conv_id", "turn", "role", "text", F.concat(F.array(head, tail, part("image", ref=ref("image"), tokens=F.length(text))), more).alias("parts")
    )
    df = chat_format(messages)
    return df.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["index"], a["type"], a["ref"], a["tokens"])), ",").alias("attachments"),
        "attachment_tokens",
    )


PARTS_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', 'CONTROL' UNION ALL SELECT -1, 1, 'assistant', 'CONTROL'
),
f AS (
  SELECT conv_id, turn, 0 AS k, 'image' AS type, 'image/' || conv_id || '/' || turn AS ref, length(text) AS tokens FROM c
  UNION ALL SELECT conv_id, turn, 1, CASE WHEN turn % 2 = 0 THEN 'audio' ELSE 'document' END, 'file/' || conv_id || '/' || turn, 0 FROM c WHERE turn % 3 = 2
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM f
), a AS (
  SELECT conv_id, count(*) AS n, string_agg(i || ':' || type || ':' || ref || ':' || tokens, ',' ORDER BY i) AS attachments,
    sum(tokens) AS tokens, sum(length('<|' || type || ':' || i || '|>')) AS chars FROM n GROUP BY conv_id
), g AS (
  SELECT conv_id, sum(length('<|im_start|>' || replace(regexp_replace(role, '<(!*)\|', '<!\1|', 'g'), chr(10), '<|nl|>') || chr(10)
    || regexp_replace(text, '<(!*)\|', '<!\1|', 'g')
    || '<|im_end|>' || chr(10))) AS chars FROM c GROUP BY conv_id
)
SELECT conv_id, CAST(g.chars + a.chars AS BIGINT) AS formatted_chars, a.n AS n_attachments, attachments,
  CAST(tokens AS BIGINT) AS attachment_tokens
FROM g JOIN a USING (conv_id)
""".replace("CONTROL", CONTROL)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents share, in every document; see `line_dedup`."""
    df = line_dedup(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS pos FROM d
), k AS (
  SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


def op3_sp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document; see `sample_digest`."""
    return sample_digest(_read(spark, sf_dir, "documents"), samples=2)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every 50th one; see `top_k`."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("x"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP4_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(q.x)), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the mix; see `mix_sources`."""
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document; see `kn_quality`."""
    return kn_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document; see `near_components`."""
    return near_components(_read(spark, sf_dir, "documents"), percent=80, words=4)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) END AS sh
  FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
r(doc_id, low) AS (
  SELECT doc_id, doc_id FROM s
  UNION SELECT CASE WHEN e.a = r.doc_id THEN e.b ELSE e.a END, r.low FROM r JOIN e ON r.doc_id IN (e.a, e.b)
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(low) AS component_id, s.doc_id = min(low) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, sh
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; see `token_counts`."""
    return token_counts(_read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase collocations of every language; see `collocations`."""
    return collocations(_read(spark, sf_dir, "documents"), shortest=2, longest=3, min_count=10, cover=50, top=2000)


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda s: array_to_string(list_slice(ws, s, s + k - 1), ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM g GROUP BY lang, phrase, k
), n AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.*, h.f AS l, t.f AS r, cut, 1000000 * a * a // (h.f * t.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c) AS c
  JOIN f AS h ON h.lang = c.lang AND h.phrase = array_to_string(ws[:cut], ' ')
  JOIN f AS t ON t.lang = c.lang AND t.phrase = array_to_string(ws[cut + 1:], ' ')
), s AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[2:], ' '), array_to_string(ws[:k - 1], ' ')]) AS sub FROM c WHERE k > 2) GROUP BY lang, sub
), r AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM s LEFT JOIN o ON o.lang = s.lang AND o.sub = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see `extract_pages`."""
    return extract_pages(_read(spark, sf_dir, "pages"))


# For pages that mark their article; tests hold other pages against expected texts.
OP12_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h[1-6]|ul|ol|li|div|section|blockquote)( [^>]*)?>'), lambda x:
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<br */?>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&amp(;?)', '&amp;', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-tokenizer alignment of every document; see `align_tokens`."""
    df = align_tokens(_read(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return df.select(F.col("doc_id").cast("long"), *df.columns[1:-1], digest.alias("groups_sha256"))


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_sp_sampling": op3_sp_sampling,
        "op4_topk_search": op4_topk_search,
        "op5_chat_format": op5_chat_format,
        "op6_mixing": op6_mixing,
        "op7_line_dedup": op7_line_dedup,
        "op8_kn_quality": op8_kn_quality,
        "op9_near_dedup": op9_near_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_collocations": op11_collocations,
        "op12_html_extract": op12_html_extract,
        "op13_alignment": op13_alignment,
        "chat_parts": chat_parts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op2_quality_rules": OP2_SQL,
        "op4_topk_search": OP4_SQL,
        "op5_chat_format": OP5_SQL,
        "op7_line_dedup": OP7_SQL,
        "op9_near_dedup": OP9_SQL,
        "op11_collocations": OP11_SQL,
        "op12_html_extract": OP12_SQL,
        "chat_parts": PARTS_SQL,
    }
