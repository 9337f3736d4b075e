"""Search over the memory table: batch, scoped, single, and results aligned with their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoloom.functions.hits import normalize_hits
from memoloom.functions.scopes import column_or, visible_scopes
from memoloom.functions.text import is_blank, strip
from memoloom.operators.embedding import Embedder, embed
from memoloom.operators.lookup import lookup
from memoloom.operators.similarity import knn_join
from memoloom.schemas import DEFAULT_MIN_SCORE, DEFAULT_TOP_K, GLOBAL_SCOPE
from memoloom.workspace import materialized

# What a hit shows of a memory; the vector stays behind.
PAYLOAD_COLUMNS = ("text", "category", "scope", "importance", "timestamp", "metadata")


def with_scope(memories: DataFrame) -> DataFrame:
    """Memories with a scope column; tables without one, and rows without a value, count as global."""
    return memories.withColumn("scope", F.coalesce(column_or(memories, "scope"), F.lit(GLOBAL_SCOPE)))


def search_vectors(
    queries: DataFrame,
    memories: DataFrame,
    *,
    top_k: int = DEFAULT_TOP_K,
    min_score: float | None = DEFAULT_MIN_SCORE,
    metric: str = "l2",
    **options,
) -> DataFrame:
    """query_id, id, score, rank for queries given as (query_id, vector, user_id).

    With a user a query reads the global scope and the user's own; without one it reads everything.
    """
    asked = queries.withColumn("_scopes", visible_scopes(column_or(queries, "user_id")))
    scoped = "user_id" in queries.columns
    return knn_join(
        asked,
        with_scope(memories),
        k=top_k,
        min_score=min_score,
        metric=metric,
        query_scopes="_scopes" if scoped else None,
        **options,
    )


def attach_payload(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Hits with what they show of their memory.

    The memories are reduced to the ids hit before anything is joined, and copies that share an id to one row. A
    memory that very many queries hit is spread over tasks. `hits` is read several times: pass a materialised frame
    when it is costly.
    """
    shown = [c for c in PAYLOAD_COLUMNS if c in memories.columns]
    wanted = hits.select("id").distinct()
    payload = memories.select("id", *shown).join(wanted, "id", "left_semi")
    payload = payload.groupBy("id").agg(F.min(F.struct(*shown)).alias("_payload"))
    return lookup(hits, payload, "id", F.xxhash64("query_id")).select(*hits.columns, "_payload.*")


def align(queries: DataFrame, hits: DataFrame, out: str = "results") -> DataFrame:
    """Every query with its hits, best first, as an array; [] for queries without any, blank ones included."""
    fields = [c for c in hits.columns if c not in ("query_id", "rank")]
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("hit"))), _by_rank)
    listed = hits.groupBy("query_id").agg(F.transform(ranked, lambda h: h["hit"]).alias(out))
    hit_type = "array<" + hits.select(F.struct(*fields).alias("h")).schema["h"].dataType.simpleString() + ">"
    return queries.join(listed, "query_id", "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast(hit_type))
    )


def _by_rank(a, b):
    return F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)


def search_batch(
    queries: DataFrame,
    memories: DataFrame,
    embedder: Embedder,
    *,
    top_k: int = DEFAULT_TOP_K,
    min_score: float | None = DEFAULT_MIN_SCORE,
    metric: str = "l2",
    **options,
) -> DataFrame:
    """One row per hit for queries (query_id, query, optional user_id); blank queries have none."""
    texts = queries.withColumn("query", strip("query")).where(~is_blank("query"))
    asked = embed(texts, embedder, "query", query=True)
    if embedder.costly:
        asked = materialized(asked, "queries")  # the search reads its queries several times
    hits = search_vectors(asked, memories, top_k=top_k, min_score=min_score, metric=metric, **options)
    hits = materialized(hits, "hits")
    return normalize_hits(attach_payload(hits, with_scope(memories)))


def search_one(
    query: str,
    memories: DataFrame,
    embedder: Embedder,
    *,
    top_k: int = DEFAULT_TOP_K,
    min_score: float | None = DEFAULT_MIN_SCORE,
    metric: str = "l2",
) -> DataFrame:
    """Hits of a single query over all memories, best first."""
    one = memories.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    hits = search_batch(one, memories, embedder, top_k=top_k, min_score=min_score, metric=metric)
    return hits.drop("query_id").orderBy("rank")
