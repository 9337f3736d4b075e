"""Similarity joins, ranking, context and aligned results. Every vector is asked against every vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    SQL_MEMORIES,
    SQL_VECTORS,
    memories,
    sql_cosine,
    sql_hash_vector,
    sql_l2_score,
    table,
    vectors,
)
from memoloom.functions.hits import filter_min_score, normalize_hits
from memoloom.functions.text import is_blank
from memoloom.operators.context import attach_context, transcripts
from memoloom.operators.embedding import HashEmbedder
from memoloom.operators.embedding import join_vectors as joined_vectors
from memoloom.operators.grading import join_back
from memoloom.operators.search import align, attach_payload, search_one, search_vectors
from memoloom.operators.similarity import knn_join, top_k
from memoloom.workspace import materialized

MIN_SCORE = -0.5
K = 10


def _queries(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "vector", "label")


def _shown(hits):
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _sql_ranked(score: str, where: str = "true", min_score: float | None = MIN_SCORE, k: int = K) -> str:
    """CTEs `scored` and `ranked` over `vectors`."""
    floor = "true" if min_score is None else f"score >= {min_score}"
    return f"""
    scored AS (
      SELECT q.id AS query_id, m.id, {score} AS score FROM vectors q, vectors m WHERE {where}),
    ranked AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM scored WHERE {floor})
      WHERE rank <= {k})"""


SQL_SHOWN = "SELECT query_id, id, round(score, 6) AS score, rank FROM ranked"
SQL_L2 = sql_l2_score("q.vector", "m.vector")


@query("join_knn", f"WITH {SQL_VECTORS}, {_sql_ranked(SQL_L2)} {SQL_SHOWN}")
def join_knn(spark, sf_dir):
    return _shown(knn_join(_queries(spark, sf_dir), vectors(spark, sf_dir), k=K, min_score=MIN_SCORE))


@query("join_knn_regions", f"WITH {SQL_VECTORS}, {_sql_ranked(SQL_L2)} {SQL_SHOWN}")
def join_knn_regions(spark, sf_dir):
    stored = vectors(spark, sf_dir)
    return _shown(knn_join(_queries(spark, sf_dir), stored, k=K, min_score=MIN_SCORE, regions=64))


@query(
    "join_knn_cosine",
    f"WITH {SQL_VECTORS}, {_sql_ranked(sql_cosine('q.vector', 'm.vector'), min_score=0.2)} {SQL_SHOWN}",
)
def join_knn_cosine(spark, sf_dir):
    hits = knn_join(_queries(spark, sf_dir), vectors(spark, sf_dir), k=K, min_score=0.2, metric="cosine")
    return _shown(hits)


@query(
    "join_knn_single",
    f"""
    WITH {SQL_MEMORIES}, {_sql_ranked(SQL_L2, "q.vec_id = (SELECT max(vec_id) FROM vectors)")}
    SELECT r.id, r.rank, round(r.score, 6) AS score, m.text, m.category, m.scope, m.importance, m.timestamp, m.label
    FROM ranked r JOIN memories m USING (id)
    """,
)
def join_knn_single(spark, sf_dir):
    stored = memories(spark, sf_dir)
    latest = F.max_by("vector", F.col("id").cast("bigint")).alias("vector")
    one = vectors(spark, sf_dir).agg(latest).select(F.lit(0).alias("query_id"), "vector")
    hits = materialized(search_vectors(one, stored, top_k=K, min_score=MIN_SCORE), "hits")
    shown = normalize_hits(attach_payload(hits, stored))
    return shown.select(
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("score", 6).alias("score"),
        "text",
        "category",
        "scope",
        "importance",
        "timestamp",
        F.try_variant_get("metadata", "$.label", "int").alias("label"),
    ).orderBy("rank")


QUESTION = "Which passages speak of the river?"


@query(
    "join_knn_text",
    f"""
    SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, round(score, 5) AS score, text, scope
    FROM (SELECT doc_id::VARCHAR AS id, text, 'user:' || lang AS scope,
                 {sql_l2_score(sql_hash_vector(f"'{QUESTION}'", 32), sql_hash_vector("text", 32))} AS score
          FROM documents WHERE text <> '')
    QUALIFY rank <= {K}
    """,
)
def join_knn_text(spark, sf_dir):
    """One question in words, over all memories."""
    embedder = HashEmbedder(32)
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    stored = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        embedder.embed_passage("text").alias("vector"),
        F.lit("other").alias("category"),
        F.lit(0.5).alias("importance"),
        F.lit(0).cast("bigint").alias("timestamp"),
        F.concat(F.lit("user:"), "lang").alias("scope"),
        F.lit("{}").alias("metadata"),
    )
    hits = search_one(QUESTION, stored, embedder, top_k=K, min_score=None)
    return hits.select("id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 5).alias("score"), "text", "scope")


SQL_SCOPED = "q.label = 9 OR m.scope = 'global' OR m.scope = 'user:' || q.label"


@query("join_knn_scoped", f"WITH {SQL_VECTORS}, {_sql_ranked(SQL_L2, SQL_SCOPED)} {SQL_SHOWN}")
def join_knn_scoped(spark, sf_dir):
    asked = _queries(spark, sf_dir).select(
        "query_id", "vector", F.when(F.col("label") != 9, F.col("label").cast("string")).alias("user_id")
    )
    return _shown(search_vectors(asked, vectors(spark, sf_dir), top_k=K, min_score=MIN_SCORE))


SQL_SOUND = "m.id::BIGINT % 7 <> 0 AND m.id::BIGINT % 11 <> 0 AND m.id::BIGINT % 13 <> 0"


@query("join_knn_nonfinite", f"WITH {SQL_VECTORS}, {_sql_ranked(SQL_L2, SQL_SOUND)} {SQL_SHOWN}")
def join_knn_nonfinite(spark, sf_dir):
    # Every seventh, eleventh and thirteenth memory has a NaN, null or infinite component: it is nobody's hit.
    n = F.col("id").cast("bigint")
    bad = (
        F.when(n % 7 == 0, F.lit(float("nan"))).when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.lit(float("inf")))
    )
    spoilt = (n % 7 == 0) | (n % 11 == 0) | (n % 13 == 0)
    tail = F.slice("vector", F.lit(2), F.size("vector"))
    vector = F.when(spoilt, F.concat(F.array(bad.cast("float")), tail)).otherwise(F.col("vector"))
    stored = vectors(spark, sf_dir).withColumn("vector", vector)
    return _shown(knn_join(_queries(spark, sf_dir), stored, k=K, min_score=MIN_SCORE))


@query("filter_min_score", f"WITH {SQL_VECTORS}, {_sql_ranked(SQL_L2, min_score=-0.4)} {SQL_SHOWN}")
def filter_min_score_query(spark, sf_dir):
    hits = knn_join(_queries(spark, sf_dir), vectors(spark, sf_dir), k=K, min_score=-0.4)
    return _shown(filter_min_score(hits, -0.4))


@query(
    "topk_rank",
    """
    SELECT doc_id, source AS query_id, n_chars AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
    WHERE rank <= 10
    """,
)
def topk_rank(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("query_id"), F.col("n_chars").alias("score")
    )
    return top_k(scored, 10, tie="doc_id").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "join_align_queries",
    f"""
    WITH {SQL_VECTORS}, {_sql_ranked(SQL_L2, "q.label <> 0", min_score=-0.2)}
    SELECT q.id AS query_id, count(r.id) AS hits, coalesce(string_agg(r.id, ',' ORDER BY r.rank), '') AS ids
    FROM vectors q LEFT JOIN ranked r ON r.query_id = q.id GROUP BY 1
    """,
)
def join_align_queries(spark, sf_dir):
    # Queries of label 0 count as blank: they are not searched, and still have their row.
    asked = _queries(spark, sf_dir).withColumn("query", F.when(F.col("label") == 0, F.lit(" ")).otherwise(F.lit("q")))
    searched = asked.where(~is_blank("query"))
    hits = knn_join(searched, vectors(spark, sf_dir), k=K, min_score=-0.2)
    aligned = align(asked.select("query_id"), hits)
    return aligned.select(
        "query_id", F.size("results").cast("bigint").alias("hits"), F.array_join("results.id", ",").alias("ids")
    )


@query(
    "agg_context",
    f"""
    WITH {SQL_MEMORIES}, {_sql_ranked(SQL_L2)},
    lines AS (
      SELECT r.query_id, r.rank, r.id,
             '[' || r.rank || '] (id=' || r.id || ', category=' || m.category || ', scope=' || m.scope || ', score='
             || printf('%.3f', r.score) || ') ' || m.text AS line
      FROM ranked r JOIN memories m USING (id))
    SELECT v.id AS query_id, coalesce(string_agg(line, chr(10) ORDER BY rank), '') AS context,
           coalesce(string_agg(l.id, ',' ORDER BY rank), '') AS context_ids
    FROM vectors v LEFT JOIN lines l ON l.query_id = v.id GROUP BY 1
    """,
)
def agg_context(spark, sf_dir):
    stored, asked = memories(spark, sf_dir), _queries(spark, sf_dir)
    hits = materialized(knn_join(asked, stored, k=K, min_score=MIN_SCORE), "hits")
    contexts = attach_context(asked.select("query_id"), attach_payload(hits, stored))
    return contexts.withColumn("context_ids", F.array_join("context_ids", ","))


@query(
    "agg_transcript",
    """
    SELECT conv_id, count(*) AS turns,
           CASE WHEN conv_id % 2 = 0 THEN '[Session Date: day ' || conv_id || ']' || chr(10)
                ELSE '' END
             || string_agg(CASE WHEN role = 'system' THEN 'Unknown' ELSE role END || ': ' || text, chr(10)
                           ORDER BY turn) AS transcript
    FROM conversations GROUP BY conv_id
    """,
)
def agg_transcript(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") != "system", F.col("role")).alias("speaker"),
        "text",
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("day "), F.col("conv_id").cast("string"))).alias("date"),
    )
    return transcripts(turns, ["conv_id"], date="date")


@query(
    "join_results_back",
    """
    SELECT d.doc_id AS item_id, d.text AS question, l.quality::VARCHAR AS quality, l.toxic::VARCHAR AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)
def join_results_back(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"))
    graded = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
    )
    return join_back(items, graded)


@query(
    "join_vectors",
    """
    SELECT doc_id::VARCHAR AS id, text, len(embedding)::VARCHAR AS dimension, embedding[1]::DOUBLE AS first_component
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id
    """,
)
def join_vectors(spark, sf_dir):
    payloads = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    ready = vectors(spark, sf_dir)
    return joined_vectors(payloads, ready).select(
        "id",
        "text",
        F.size("vector").cast("string").alias("dimension"),
        F.element_at("vector", 1).cast("double").alias("first_component"),
    )
