"""Projections, filters, scalar functions and set operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    NOW_MS,
    choice,
    doc_files,
    doc_path,
    sql_choice,
    sql_doc_path,
    sql_hash_vector,
    sql_strip,
    sql_uuid,
    table,
    vectors,
    SQL_VECTORS,
)
from memoloom.functions.entries import flatten_entries, materialize, normalize_entries
from memoloom.functions.hits import normalize_hits
from memoloom.functions.ranges import filter_numbers, range_members
from memoloom.functions.scopes import (
    column_or,
    filter_scope,
    infer_category,
    path_user,
    sample_user,
    session_path,
    user_scope,
)
from memoloom.functions.text import clean_text
from memoloom.operators.embedding import CachedEmbedder, HashEmbedder, ModelEmbedder, embed
from memoloom.sources.parsers import parse_markdown, parse_text, union_payloads
from memoloom.sources.sessions import number_sessions
from memoloom.workspace import fresh_path

# ---------------------------------------------------------------------------------------------- clean text


@query(
    "proj_clean_text",
    f"""
    WITH padded AS (
      SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN chr(12288) || chr(10) || ' '
                          ELSE chr(160) || chr(9) || text || chr(8195) || chr(13) END AS text
      FROM documents)
    SELECT doc_id, {sql_strip("text")} AS text FROM padded WHERE {sql_strip("text")} <> ''
    """,
)
def proj_clean_text(spark, sf_dir):
    padded = F.when(F.col("doc_id") % 11 == 0, F.lit("　\n ")).otherwise(
        F.concat(F.lit("\xa0\t"), "text", F.lit(" \r"))
    )
    return clean_text(table(spark, sf_dir, "documents").select("doc_id", padded.alias("text")))


# ---------------------------------------------------------------------------------------------- entries


@query(
    "proj_normalize_entry",
    f"""
    SELECT doc_id, {sql_strip("text")} AS text,
           CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE lang END AS category,
           CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE (doc_id % 10) / 10.0 END::DOUBLE AS importance,
           CASE WHEN doc_id % 5 = 0 THEN '{{}}' ELSE source END AS metadata,
           'global' AS scope
    FROM documents WHERE doc_id % 13 <> 0
    """,
)
def proj_normalize_entry(spark, sf_dir):
    n = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 13 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"),
        F.when(n % 3 != 0, F.col("lang")).alias("category"),
        F.when(n % 4 != 0, (n % 10) / 10.0).alias("importance"),
        F.when(n % 5 != 0, F.col("source")).alias("metadata"),
    )
    return normalize_entries(raw)


@query(
    "proj_path_category",
    f"""
    SELECT doc_id,
           CASE WHEN p LIKE '%/preferences/%' OR lower(split_part(p, '/', -1)) LIKE 'profile%' THEN 'preference'
                WHEN p LIKE '%/events/%' THEN 'fact' WHEN p LIKE '%/entities/%' THEN 'entity' ELSE 'other' END
             AS category
    FROM (SELECT doc_id, {sql_doc_path("CASE WHEN doc_id % 5 = 0 THEN '/Profile.md' ELSE '.md' END")} AS p
          FROM documents)
    """,
)
def proj_path_category(spark, sf_dir):
    suffix = F.when(F.col("doc_id") % 5 == 0, F.lit("/Profile.md")).otherwise(F.lit(".md"))
    return doc_files(spark, sf_dir, suffix).select("doc_id", infer_category("path").alias("category"))


@query(
    "proj_materialize",
    f"""
    SELECT doc_id,
           CASE WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id
                ELSE {sql_uuid(sql_doc_path(), "''", "text")} END AS id,
           {sql_strip("text")} AS text,
           CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'user:' || lang END AS scope,
           greatest(0.0, least(1.0, (doc_id % 20) / 10.0 - 0.5))::DOUBLE AS importance,
           CASE WHEN doc_id % 7 = 0 THEN {NOW_MS} WHEN doc_id % 7 = 1 THEN 1696118400000 ELSE n_chars END AS timestamp,
           CASE WHEN doc_id % 7 = 0 THEN {NOW_MS} WHEN doc_id % 7 = 1 THEN 1696118400000 ELSE n_chars END AS created_at,
           '{{}}' AS metadata
    FROM documents WHERE {sql_strip("text")} <> ''
    """,
)
def proj_materialize(spark, sf_dir):
    n = F.col("doc_id")
    payloads = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 2 == 0, F.concat(F.lit("doc-"), n.cast("string"))).alias("id"),
        doc_path().alias("source_path"),
        "text",
        F.when(n % 3 != 0, user_scope("lang")).alias("scope"),
        ((n % 20) / 10.0 - 0.5).alias("importance"),
        choice(n, "-5", "2023-10-01", *[F.col("n_chars").cast("string")] * 5).alias("timestamp"),
        F.lit(None).cast("string").alias("metadata"),
    )
    rows = materialize(clean_text(payloads), NOW_MS)
    return rows.select(
        "doc_id", "id", "text", "scope", "importance", "timestamp", F.col("createdAt").alias("created_at"), "metadata"
    )


# ---------------------------------------------------------------------------------------------- filters


@query(
    "filter_samples",
    """
    SELECT conv_id, turn + 1 AS session, '1,3,4,5' AS sessions_kept
    FROM conversations
    WHERE (conv_id BETWEEN 0 AND 3 OR conv_id = 7 OR conv_id >= 12) AND turn + 1 IN (1, 3, 4, 5)
    """,
)
def filter_samples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("session"))
    kept = filter_numbers(filter_numbers(turns, "conv_id", "0-3, 7,12-999999999999"), "session", "3-5,1")
    return kept.withColumn("sessions_kept", F.array_join(range_members(F.lit("3-5,1,4")), ","))


@query(
    "filter_scope",
    f"""
    WITH {SQL_VECTORS}
    SELECT id, scope FROM vectors WHERE scope = 'global' OR scope = 'user:3'
    """,
)
def filter_scope_query(spark, sf_dir):
    return filter_scope(vectors(spark, sf_dir), "3").select("id", "scope")


@query(
    "proj_assign_user",
    """
    SELECT conv_id, turn, 'user_' || conv_id AS user_id,
           'sessions/user_' || conv_id || '/session_' || (turn + 1) AS path,
           'user:user_' || conv_id AS scope,
           'user_' || substr(md5('sessions/user_' || conv_id || '/session_' || (turn + 1)), 1, 8) AS agent_user,
           'someone' AS override_user
    FROM conversations
    """,
)
def proj_assign_user(spark, sf_dir):
    user = sample_user("conv_id")
    session = F.concat(F.lit("session_"), (F.col("turn") + 1).cast("string"))
    path = session_path(user, session)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        user.alias("user_id"),
        path.alias("path"),
        user_scope(user).alias("scope"),
        path_user(path).alias("agent_user"),
        sample_user("conv_id", "someone").alias("override_user"),
    )


@query(
    "proj_missing_column",
    "SELECT doc_id, lang, NULL::VARCHAR AS user_id, '' AS context, 'unknown' AS id FROM documents",
)
def proj_missing_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        column_or(docs, "lang").alias("lang"),
        column_or(docs, "user_id").alias("user_id"),
        column_or(docs, "context", "").alias("context"),
        column_or(docs, "id", "unknown").alias("id"),
    )


# ---------------------------------------------------------------------------------------------- order and sets


@query(
    "sort_sessions",
    """
    SELECT conv_id AS sample, 'session_' || (turn * 7 + 3) AS name,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn * 7 + 3) AS position
    FROM conversations
    """,
)
def sort_sessions(spark, sf_dir):
    number = (F.col("turn") * 7 + 3).cast("string")
    sessions = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("sample"), number.alias("session"), F.concat(F.lit("session_"), number).alias("name")
    )
    return number_sessions(sessions).select("sample", "name", F.col("position").cast("bigint").alias("position"))


@query(
    "set_union_payloads",
    f"""
    SELECT {sql_strip("text")} AS text, 'markdown' AS source,
           {sql_choice("doc_id", "'preference'", "'fact'", "'entity'", "'other'")} AS category,
           CASE WHEN doc_id % 4 = 3 THEN 0.7 ELSE 0.8 END::DOUBLE AS importance
    FROM documents
    UNION ALL
    SELECT {sql_strip("text")}, 'text', 'other', 0.6::DOUBLE FROM documents
    """,
)
def set_union_payloads(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    whole = union_payloads([parse_markdown(files), parse_text(files)])
    return whole.select("text", F.get_json_object("metadata", "$.source").alias("source"), "category", "importance")


@query(
    "set_flatten_entries",
    """
    SELECT doc_id, lang || '-' || i AS text, source AS category
    FROM documents, range(3) t(i) WHERE i < doc_id % 4 AND doc_id % 4 <> 3
    """,
)
def set_flatten_entries(spark, sf_dir):
    n = (F.col("doc_id") % 4).cast("int")
    numbers = F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), n)

    def entry(i):
        return F.struct(F.concat("lang", F.lit("-"), i.cast("string")).alias("text"), F.col("source").alias("category"))

    entries = F.transform(numbers, entry)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(n != 3, entries).alias("entries"))
    return flatten_entries(docs, "entries", keep=("doc_id",))


# ---------------------------------------------------------------------------------------------- hits and vectors


@query(
    "fn_normalize_hit",
    f"""
    WITH {SQL_VECTORS}
    SELECT id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label END::VARCHAR AS label,
           CASE WHEN vec_id % 3 = 0 THEN 'plain text' END AS raw_metadata,
           CASE WHEN vec_id % 4 = 0 THEN 'global' ELSE scope END AS scope,
           CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE label / 8.0 END::DOUBLE AS score
    FROM vectors
    """,
)
def fn_normalize_hit(spark, sf_dir):
    n = F.col("id").cast("bigint")
    label = F.col("label").cast("string")
    raw = vectors(spark, sf_dir).select(
        "id",
        F.when(n % 3 == 0, F.lit("plain text"))
        .otherwise(F.concat(F.lit('{"label": '), label, F.lit("}")))
        .alias("metadata"),
        F.when(n % 4 != 0, F.col("scope")).alias("scope"),
        choice(n, F.lit("n/a"), *[(F.col("label") / 8.0).cast("string")] * 4).alias("score"),
    )
    hits = normalize_hits(raw)
    return hits.select(
        "id",
        F.try_variant_get("metadata", "$.label", "string").alias("label"),
        F.when(F.schema_of_variant("metadata") == "STRING", F.col("metadata").cast("string")).alias("raw_metadata"),
        "scope",
        "score",
    )


@query(
    "udf_embed",
    f"""
    SELECT doc_id, i AS position, round(v[i + 1], 6) AS component
    FROM (SELECT doc_id, {sql_hash_vector("text", 16)} AS v FROM documents), range(16) t(i)
    """,
)
def udf_embed(spark, sf_dir):
    embedder = HashEmbedder(16)
    vectors_of = table(spark, sf_dir, "documents").select("doc_id", embedder.embed_passage("text").alias("vector"))
    return vectors_of.select("doc_id", F.posexplode("vector").alias("position", "x")).select(
        "doc_id",
        F.col("position").cast("bigint").alias("position"),
        F.round(F.col("x").cast("double"), 6).alias("component"),
    )


LETTERS = "abcdefghijklmnop"
ASK = "peak: "


def _sql_letters(text: str) -> str:
    counts = ", ".join(f"length({text}) - length(replace({text}, '{letter}', ''))" for letter in LETTERS)
    return f"CASE WHEN coalesce(text, '') <> '' THEN [{counts}] ELSE list_transform(range({len(LETTERS)}), lambda i: 0) END"


@query(
    "udf_embed_model",
    f"""
    WITH counted AS (
      SELECT doc_id, 'passage' AS kind, {_sql_letters("text")} AS v FROM documents
      UNION ALL
      SELECT doc_id, 'query', {_sql_letters(f"('{ASK}' || text)")} FROM documents)
    SELECT doc_id, kind, i AS position,
           round(coalesce(v[i + 1] / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))), 0), 0.0)::FLOAT::DOUBLE, 5)
             AS component
    FROM counted, range({len(LETTERS)}) t(i)
    """,
)
def udf_embed_model(spark, sf_dir):
    """A model behind a cache: passages and queries, each text embedded once; a second run finds all vectors."""

    def letter_model():  # counts letters, in place of a model with weights
        return lambda texts: np.array([[text.count(letter) for letter in LETTERS] for text in texts], np.float32)

    model = ModelEmbedder(letter_model, len(LETTERS), query_instruction=ASK)
    cache = CachedEmbedder(model, fresh_path(spark, "vectors"), "letters")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    embed(docs, cache)
    kinds = [
        embed(docs, cache, query=asked).select("doc_id", F.lit(kind).alias("kind"), F.posexplode("vector").alias("position", "x"))
        for kind, asked in (("passage", False), ("query", True))
    ]
    return kinds[0].union(kinds[1]).select(
        "doc_id",
        "kind",
        F.col("position").cast("bigint").alias("position"),
        F.round(F.col("x").cast("double"), 5).alias("component"),
    )
