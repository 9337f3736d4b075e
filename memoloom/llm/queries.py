"""The operators over the supplied tables as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.llm import alignment, contamination, licences, minhash, multi_index, packing, pages, pivots, preferences, quality, repeats, simhash, tokens
from memoloom.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    tokens.write_ids(table(spark, sf_dir, "documents"), path)
    return tokens.read_ids(spark, path)


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)


@query(
    "op10_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (
      SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
      FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT n FROM win),
    grams AS (
      SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)
    ),
    hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win USING (n, phrase)),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    its AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_pivot_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    ) WHERE rank <= 10
    """,
)
def pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.nearest_to_every(table(spark, sf_dir, "embeddings"))


@query("op9_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def _shown(turns: str) -> str:
    """SQL of (pair_id, text) from numbered turns."""
    return f"""SELECT pair_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS shown
               FROM {turns} GROUP BY pair_id"""


def _spans(turns: str) -> str:
    """SQL of (pair_id, spans) from the numbered turns of prompt and continuation."""
    return f"""SELECT pair_id, string_agg(CAST(s AS VARCHAR) || '-' || CAST(s + len(text) + 10 AS VARCHAR), ',' ORDER BY pos) AS spans FROM (
                 SELECT *, coalesce(sum(len(role) + len(text) + 24) OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                           + len(role) + 13 AS s FROM {turns}
               ) WHERE role = 'assistant' AND pos > n_common GROUP BY pair_id"""


@query(
    "op6_preference_formatting",
    f"""
    WITH c AS (
      SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    ids AS (SELECT pair_id, max(pos) AS n, max(CASE WHEN role = 'assistant' THEN pos END) AS last FROM c GROUP BY pair_id),
    reply AS (SELECT c.pair_id - 1 AS pair_id, c.text FROM c JOIN ids ON c.pair_id = ids.pair_id AND c.pos = ids.last),
    r AS (
      SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS pos FROM (
        SELECT c.pair_id, c.role, CASE WHEN c.pos = ids.last THEN reply.text ELSE c.text END AS text, c.pos
        FROM c JOIN ids ON c.pair_id = ids.pair_id LEFT JOIN reply ON reply.pair_id = c.pair_id
      ) WHERE text IS NOT NULL
    ),
    differ AS (
      SELECT pair_id, min(pos) - 1 AS n FROM (
        SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos
        WHERE c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text
      ) GROUP BY pair_id
    ),
    k AS (SELECT ids.pair_id, coalesce(differ.n, ids.n) AS n_common FROM ids LEFT JOIN differ ON ids.pair_id = differ.pair_id),
    ck AS (SELECT c.*, k.n_common FROM c JOIN k ON c.pair_id = k.pair_id),
    rk AS (SELECT r.*, k.n_common FROM r JOIN k ON r.pair_id = k.pair_id)
    SELECT k.pair_id, CAST(k.n_common AS BIGINT) AS n_common, coalesce(p.shown, '') AS prompt, coalesce(x.shown, '') AS chosen,
           coalesce(y.shown, '') AS rejected, coalesce(cm.spans, '') AS chosen_mask, coalesce(rm.spans, '') AS rejected_mask
    FROM k LEFT JOIN ({_shown('(SELECT * FROM ck WHERE pos <= n_common)')}) p ON p.pair_id = k.pair_id
    LEFT JOIN ({_shown('(SELECT * FROM ck WHERE pos > n_common)')}) x ON x.pair_id = k.pair_id
    LEFT JOIN ({_shown('(SELECT * FROM rk WHERE pos > n_common)')}) y ON y.pair_id = k.pair_id
    LEFT JOIN ({_spans('ck')}) cm ON cm.pair_id = k.pair_id LEFT JOIN ({_spans('rk')}) rm ON rm.pair_id = k.pair_id
    """,
)
def preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_text(table(spark, sf_dir, "conversations"))


@query("op1_licence_scan")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.document_licences(table(spark, sf_dir, "documents"))


@query(
    "op11_minhash_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    g AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS g
      FROM w
    ),
    s AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
    near AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
      GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
    ),
    links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT g.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(least.b, g.doc_id)) AS component_id,
           g.doc_id <= coalesce(least.b, g.doc_id) AS kept
    FROM g LEFT JOIN least ON g.doc_id = least.a
    """,
)
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
             list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
    ),
    p AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
    ),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
      WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(rows.withColumn("label", moved))
