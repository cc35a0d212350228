"""Queries on keyed tables: joins, set operations, first rows, roll-ups and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.operators import folds, ranking
from strandline.operators.changes import link_reasons, sharing_pairs
from strandline.operators.graph import components
from strandline.plans.registry import Tables, query


@query("semi_cluster", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_cluster(t: Tables):
    """JON-11: customers with an urgent order."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("unmatched_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_anti(t: Tables):
    """JON-10, SET-03: documents without a label."""
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("left_coalesce", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, greatest(coalesce(l.toxic, 0), 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_coalesce(t: Tables):
    """JON-01, JON-02: labels where there are any, defaults elsewhere."""
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return df.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(
    "theta_self_join",
    """WITH c AS (SELECT p_partkey AS id, p_brand || p_size AS change_type, string_split(p_name, ' ') AS tags, ['P' || p_partkey % 97] AS imports, p_type AS label, 'd' || CAST(floor(p_retailprice / 50) AS BIGINT) AS dir FROM part),
    r AS (SELECT id, change_type, unnest(list_distinct(list_concat(list_concat(list_transform(tags, lambda x: 'tag:' || x), list_transform(imports, lambda x: 'import:' || x)), ['label:' || label, 'dir:' || dir]))) AS reason FROM c)
    SELECT a.id AS a, b.id AS b, string_agg(DISTINCT a.reason, ',' ORDER BY a.reason) AS reasons FROM r a JOIN r b ON a.change_type = b.change_type AND a.reason = b.reason AND a.id < b.id GROUP BY a.id, b.id""",
)
def theta_self_join(t: Tables):
    """JON-07: pairs of parts of one brand and size with all the reasons that link them: a shared tag or import, an equal
    label or folder."""
    folder = F.concat(F.lit("d"), F.floor(F.col("p_retailprice") / 50))
    changed = t.part.select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", "p_size").alias("change_type"), F.split("p_name", " ").alias("tags"),
        F.array(F.concat(F.lit("P"), F.col("p_partkey") % 97)).alias("imports"), F.col("p_type").alias("label"), folder.alias("dir"),
    )
    return link_reasons(changed).select("a", "b", F.array_join("reasons", ",").alias("reasons"))


@query(
    "fallback_cascade",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name, 'none') AS resolved
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def fallback_cascade(t: Tables):
    """JON-13: the first source that names a customer: itself, its nation, its region."""
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    df = df.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    own = F.when(F.col("c_acctbal") > 5000, F.col("c_name"))
    nation = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return df.select("c_custkey", F.coalesce(own, nation, "r_name", F.lit("none")).alias("resolved"))


UNION_SQL = """
  SELECT n_name AS repo, 'supplier' AS strategy, 0.7e0 + 0.01e0 * (s_suppkey % 20) AS confidence, 3 AS priority, s_name AS evidence FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'customer', 0.6e0 + 0.01e0 * (c_custkey % 30), 4, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'self', 0.35e0, 1, 'fallback' FROM nation"""


def _candidates(t: Tables):
    nation = t.nation.select("n_nationkey", F.col("n_name").alias("repo"))
    s = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "repo", F.lit("supplier").alias("strategy"), (0.7 + 0.01 * (F.col("s_suppkey") % 20)).alias("confidence"), F.lit(3).alias("priority"), F.col("s_name").alias("evidence")
    )
    c = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "repo", F.lit("customer").alias("strategy"), (0.6 + 0.01 * (F.col("c_custkey") % 30)).alias("confidence"), F.lit(4).alias("priority"), F.col("c_name").alias("evidence")
    )
    own = nation.select("repo", F.lit("self").alias("strategy"), F.lit(0.35).alias("confidence"), F.lit(1).alias("priority"), F.lit("fallback").alias("evidence"))
    return s.unionByName(c).unionByName(own)


@query("candidate_union", f"SELECT repo, strategy, count(*) AS n, max(confidence) AS best FROM ({UNION_SQL}) GROUP BY repo, strategy")
def candidate_union(t: Tables):
    """SET-01, SET-02: all candidates of three strategies."""
    return _candidates(t).groupBy("repo", "strategy").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@query(
    "candidate_rank",
    f"""SELECT repo, strategy, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, confidence DESC, evidence DESC) AS r
    FROM ({UNION_SQL})) WHERE r = 1""",
)
def candidate_rank(t: Tables):
    """WIN-01, SRT-01: the best candidate of each repository."""
    best = ranking.first_per_key(_candidates(t), ["repo"], [F.desc("priority"), F.desc("confidence"), F.desc("evidence")])
    return best.select("repo", "strategy", "confidence", "evidence")


@query("first_per_key", """SELECT l_orderkey, l_returnflag, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def first_per_key(t: Tables):
    """WIN-02: the first line of each order and flag."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return ranking.first_per_key(t.lineitem, ["l_orderkey", "l_returnflag"], order).select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")


@query("ordinal_ids", """SELECT o_orderkey, o_custkey, 'C' || o_custkey || '.S' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal_id FROM orders""")
def ordinal_ids(t: Tables):
    """WIN-09: numbered ids inside each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ordinal = F.concat(F.lit("C"), F.col("o_custkey"), F.lit(".S"), F.row_number().over(w))
    return t.orders.select("o_orderkey", "o_custkey", ordinal.alias("ordinal_id"))


@query(
    "coverage_histogram",
    """WITH k AS (SELECT unnest(['FULL', 'PARTIAL', 'APPROXIMATED', 'MISSING']) AS coverage)
    SELECT k.coverage, count(l.doc_id) AS n FROM k LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'FULL' WHEN quality = 1 THEN 'PARTIAL' WHEN toxic = 1 THEN 'APPROXIMATED' END AS coverage FROM labels) l USING (coverage) GROUP BY k.coverage""",
)
def coverage_histogram(t: Tables):
    """AGG-03: a count for each coverage kind, the empty one included."""
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "FULL").when(F.col("quality") == 1, "PARTIAL").when(F.col("toxic") == 1, "APPROXIMATED")
    counts = t.labels.groupBy(kind.alias("coverage")).agg(F.count("*").alias("n"))
    keys = t.spark.sql("SELECT explode(array('FULL', 'PARTIAL', 'APPROXIMATED', 'MISSING')) AS coverage")
    return keys.join(counts, "coverage", "left").select("coverage", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(
    "title_merge",
    """SELECT key, min(conv_id) AS first_conv, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE r <= 6) AS convs
    FROM (SELECT conv_id, lower(text) AS key, row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id) AS r FROM conversations WHERE turn = 0) GROUP BY key""",
)
def title_merge(t: Tables):
    """SEQ-06: conversations with one first text, merged under the first, with the first six of them."""
    df = t.conversations.where("turn = 0").select("conv_id", F.lower("text").alias("key"))
    w = Window.partitionBy("key").orderBy("conv_id")
    top = df.withColumn("r", F.row_number().over(w)).where("r <= 6").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("convs"))
    return df.groupBy("key").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n")).join(top, "key").select("key", "first_conv", "n", "convs")


@query(
    "related_clusters",
    """WITH t AS (SELECT DISTINCT s_suppkey AS id, unnest(['n' || s_nationkey, 'b' || (s_suppkey % 11)]) AS tag FROM supplier)
    SELECT a.id AS a, b.id AS b, count(*) AS shared FROM t a JOIN t b ON a.tag = b.tag AND a.id < b.id GROUP BY a.id, b.id""",
)
def related_clusters(t: Tables):
    """JON-14, GRF-03: suppliers that share a tag, and how many they share."""
    tags = F.array(F.concat(F.lit("n"), F.col("s_nationkey")), F.concat(F.lit("b"), F.col("s_suppkey") % 11))
    return sharing_pairs(t.supplier.select(F.col("s_suppkey").alias("id"), tags.alias("tags")))


@query("bucket_counts", """SELECT lang, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE n_chars BETWEEN 500 AND 3000) AS medium, count(*) FILTER (WHERE n_chars > 3000) AS long, CAST(sum(n_chars) AS BIGINT) // 1024 AS kb FROM documents GROUP BY lang""")
def bucket_counts(t: Tables):
    """AGG-10, AGG-11, REV-08: counts by size bucket in one pass."""
    n = F.col("n_chars")
    return t.documents.groupBy("lang").agg(
        F.count_if(n < 500).alias("short"), F.count_if(n.between(500, 3000)).alias("medium"), F.count_if(n > 3000).alias("long"), F.floor(F.sum(n) / 1024).cast("long").alias("kb")
    )


@query(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey), m AS (SELECT s FROM e GROUP BY s HAVING count(*) > 1),
    g AS (SELECT c * 2 AS a, s * 2 + 1 AS b FROM e UNION ALL SELECT s * 2 + 1, c * 2 FROM e),
    cc(id, low) USING KEY (id) AS (SELECT DISTINCT a, a FROM g UNION (SELECT g.b, min(cc.low) FROM cc JOIN g ON g.a = cc.id JOIN recurring.cc AS old ON old.id = g.b WHERE cc.low < old.low GROUP BY g.b)),
    t AS (SELECT low, min(id) FILTER (WHERE id % 2 = 0) // 2 AS component FROM cc GROUP BY low)
    SELECT node, component FROM (SELECT DISTINCT c AS node FROM e SEMI JOIN m USING (s)) JOIN cc ON id = node * 2 JOIN t USING (low)""",
)
def connected_components(t: Tables):
    """GRF-01, GRF-02: customers linked through a supplier of any line item. The graph is the bipartite one, so a supplier
    with many customers makes one edge for each, not one for each pair."""
    return _linked_customers(t, t.lineitem)


def _linked_customers(t: Tables, lines: DataFrame) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = lines.join(o, "l_orderkey").select(F.col("o_custkey").alias("c"), "l_suppkey").distinct()
    top = 1 << 40  # suppliers' numbers lie above all customers'
    comps = components(edges.select((F.col("l_suppkey") + F.lit(top)).alias("a"), F.col("c").alias("b")))
    several = edges.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n > 1").select("l_suppkey")
    nodes = edges.join(several, "l_suppkey", "left_semi").select(F.col("c").alias("node")).distinct()
    return nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query(
    "sessionise_sections",
    """WITH f AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS is_head FROM conversations)
    SELECT conv_id, section, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT *, CAST(sum(is_head) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM f) GROUP BY conv_id, section""",
)
def sessionise_sections(t: Tables):
    """WIN-12, STR-30: sections that each user turn opens."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    df = t.conversations.select("conv_id", F.length("text").alias("n"), F.sum((F.col("role") == "user").cast("int")).over(w).alias("section"))
    return df.groupBy("conv_id", "section").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"))


@query(
    "running_budget",
    f"""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(left(text, {V.PARSE_SECTION_CHARS})) AS n FROM conversations),
    r(conv_id, k, used, taken, stop) AS (
      SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM (SELECT DISTINCT conv_id FROM s)
      UNION ALL SELECT s.conv_id, s.k, used + least(n, {V.PARSE_TOTAL_CHARS} - used), taken + 1,
        NOT (taken + 1 < {V.PARSE_SECTIONS} AND {V.PARSE_TOTAL_CHARS} - (used + least(n, {V.PARSE_TOTAL_CHARS} - used)) >= {V.PARSE_LEAST})
      FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1 WHERE NOT stop)
    SELECT conv_id, max(taken) AS sections, max(used) AS chars FROM r GROUP BY conv_id""",
)
def running_budget(t: Tables):
    """WIN-07: turns taken in order within the reference's limits."""
    return folds.running_budget(t.conversations, "conv_id", "turn", "text", V.PARSE_SECTIONS, V.PARSE_SECTION_CHARS, V.PARSE_TOTAL_CHARS, V.PARSE_LEAST)


@query("batch_pack")
def batch_pack(t: Tables):
    """WIN-08: turns packed greedily into at most three batches, within the reference's limits."""
    return folds.pack_batches(t.conversations, "conv_id", "turn", "text", V.PARSE_SECTIONS, V.PARSE_TOTAL_CHARS, V.PARSE_BATCHES, V.PARSE_SECTION_CHARS)


@query("group_max", """SELECT source, lang, max(n_chars) AS best, bool_or(n_chars > 5000) AS any_long, least(0.95e0, max(n_chars) / 10000e0 + 0.15e0) AS confidence FROM documents GROUP BY source, lang""")
def group_max(t: Tables):
    """AGG-04: group maximum and any, with a capped linear confidence."""
    n = F.col("n_chars")
    return t.documents.groupBy("source", "lang").agg(
        F.max(n).alias("best"), F.bool_or(n > 5000).alias("any_long"), F.least(F.lit(0.95), F.max(n) / 10000.0 + 0.15).alias("confidence")
    )


@query(
    "clamped_confidence",
    """SELECT p_partkey, least(0.7e0 + 0.04e0 * (p_size % 10), 0.97e0) AS raw, least(greatest(p_retailprice / 1000e0 - 1, 0), 1) AS progress FROM part""",
)
def clamped_confidence(t: Tables):
    """MTH-05, MTH-17: clamped linear confidence and progress."""
    raw = F.least(0.7 + 0.04 * (F.col("p_size") % 10), F.lit(0.97))
    return t.part.select("p_partkey", raw.alias("raw"), S.clamp01(F.col("p_retailprice") / 1000.0 - 1).alias("progress"))
