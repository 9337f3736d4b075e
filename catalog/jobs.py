"""The composed jobs, end to end over the supplied tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    NOW_MS,
    SQL_ONE_LINE,
    one_line,
    sql_hash_vector,
    sql_l2_score,
    sql_strip,
    table,
)
from catalog.parsing import SQL_SESSIONS, samples
from catalog.searches import K, MIN_SCORE
from memoloom.functions import prompts
from memoloom.operators import inference
from memoloom.operators.embedding import Embedder, HashEmbedder
from memoloom.operators.inference import DryRun, ModelCalls, ResponsesTable
from memoloom.plans import jobs
from memoloom.sources import json_array, parsers, sessions
from memoloom.workspace import fresh_path

DIMENSION = 32
EMBEDDER = HashEmbedder(DIMENSION)


# ---------------------------------------------------------------------------------------------- import


DOCS_PER_NOTE = 50


@query(
    "job_import",
    f"""
    SELECT source, category, 'global' AS scope, importance, {NOW_MS} AS timestamp, text,
           round({sql_hash_vector("text", DIMENSION)}[1], 5) AS first_component
    FROM (
      SELECT 'jsonl' AS source, lang AS category, 0.7::DOUBLE AS importance, {sql_strip(SQL_ONE_LINE)} AS text
      FROM documents WHERE lang = 'en'
      UNION ALL
      SELECT 'result', 'fact', 0.6, concat_ws(' ', 'Graded item ' || doc_id || ' of set ' || lang || '.',
             'Question: ' || nullif({sql_strip(SQL_ONE_LINE)}, ''), 'Ground Truth: from ' || source)
      FROM documents WHERE lang = 'de'
      UNION ALL
      SELECT CASE WHEN lang = 'fr' THEN 'markdown' ELSE 'text' END, CASE WHEN lang = 'fr' THEN 'preference' ELSE 'other' END,
             CASE WHEN lang = 'fr' THEN 0.8 ELSE 0.6 END,
             {sql_strip(f"string_agg(lang || ' ' || {SQL_ONE_LINE}, chr(8232) ORDER BY doc_id)")}
      FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang = 'fr', lang, doc_id // {DOCS_PER_NOTE})
    """,
)
def job_import(spark, sf_dir):
    root, path = fresh_path(spark, "inbox"), fresh_path(spark, "memories")
    docs = table(spark, sf_dir, "documents").withColumn("t", one_line("text"))
    # English documents become JSON lines, German ones graded results; the others of a language among fifty make one note,
    # a file of its own, French ones as markdown
    note = docs.where("lang not in ('en', 'de')").groupBy("lang", F.floor(F.col("doc_id") / DOCS_PER_NOTE).alias("note"))
    notes = note.agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat("lang", F.lit(" "), "t").alias("t")))).alias("n"))
    for name, condition in (("preferences", "lang = 'fr'"), ("notes", "lang <> 'fr'")):
        bodies = notes.where(condition).select(F.array_join("n.t", "\u2028"))
        bodies.write.option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    fields = F.struct(F.col("t").alias("text"), F.col("lang").alias("category"))
    docs.where("lang = 'en'").select(F.to_json(fields)).write.text(f"{root}/lines")
    graded = docs.where("lang = 'de'").select(
        F.col("doc_id").alias("question_index"),
        F.col("lang").alias("category"),
        F.col("t").alias("question"),
        F.concat(F.lit("from "), "source").alias("ground_truth"),
    )
    json_array.write_json_arrays(graded, f"{root}/graded")

    wording = parsers.ResultWording(sentence="Graded item {index} of set {category}.")
    for folder, given in (("notes", "text"), ("preferences", "markdown"), ("lines", "jsonl"), ("graded", "result")):
        # every folder is a run of its own; the last is repeated and still gives its rows once
        options = {"input_format": given, "run_key": folder, "wording": wording}
        jobs.run_import(spark, [f"{root}/{folder}"], path, EMBEDDER, NOW_MS, **options)
    jobs.run_import(spark, [f"{root}/graded"], path, EMBEDDER, NOW_MS, **options)
    return spark.read.parquet(path).select(
        F.get_json_object("metadata", "$.source").alias("source"),
        "category",
        "scope",
        "importance",
        "timestamp",
        "text",
        F.round(F.element_at("vector", 1).cast("double"), 5).alias("first_component"),
    )


# ---------------------------------------------------------------------------------------------- ingest


def line_client():
    """An extraction model that remembers every line of a transcript."""

    def call(sent):
        lines = sent["request"].split("\n")
        return "```json\n" + json.dumps([{"text": line, "category": "fact"} for line in lines]) + "\n```"

    return call


@query(
    "job_ingest",
    f"""
    WITH {SQL_SESSIONS}
    SELECT path, user_id, {sql_strip("line")} AS text, 'fact' AS category, 'user:' || user_id AS scope,
           0.5::DOUBLE AS importance, '{NOW_MS}' AS timestamp, '{DIMENSION}' AS dimension
    FROM (SELECT path, user_id, unnest(string_split(text, chr(10))) AS line FROM sessions)
    WHERE {sql_strip("line")} <> ''
    UNION ALL
    SELECT path, user_id, 'Dry-run memory from session_' || session, 'fact', 'user:' || user_id, 0.5, '{NOW_MS}',
           '{DIMENSION}'
    FROM sessions
    UNION ALL
    SELECT path, user_id, 'Dry-run ingest: ' || path, 'agent_response', NULL, NULL, NULL, NULL FROM sessions
    """,
)
def job_ingest(spark, sf_dir):
    path = fresh_path(spark, "memories")
    texts = sessions.sessions(samples(spark, sf_dir))
    jobs.run_ingest(texts, ModelCalls(line_client), path, EMBEDDER, NOW_MS)
    jobs.run_ingest(texts, DryRun(), path, EMBEDDER, NOW_MS)
    origin = F.coalesce(F.get_json_object("metadata", "$.source_path"), F.get_json_object("metadata", "$.path"))
    stored = spark.read.parquet(path).select(
        origin.alias("path"),
        F.substring_index(F.substring_index(origin, "/", 2), "/", -1).alias("user_id"),
        "text",
        "category",
        "scope",
        "importance",
        F.col("timestamp").cast("string").alias("timestamp"),
        F.size("vector").cast("string").alias("dimension"),
    )
    told = inference.agent_ingest(texts, DryRun()).select(
        "path", "user_id", F.col("agent_response").alias("text"), F.lit("agent_response").alias("category")
    )
    return stored.unionByName(told, allowMissingColumns=True)


# ---------------------------------------------------------------------------------------------- search and evaluate


def _memories(spark, sf_dir, embedder: Embedder = EMBEDDER):
    """Documents as global memories, their vectors from the hash embedder."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        embedder.embed_passage("text").alias("vector"),
        F.col("lang").alias("category"),
        F.concat(F.lit("user:"), "lang").alias("scope"),
    )


def _sql_search(scoped: bool) -> str:
    visible = "m.scope = 'global' OR m.scope = 'user:' || q.user_id" if scoped else "true"
    return f"""
    memories AS MATERIALIZED (
      SELECT doc_id::VARCHAR AS id, text, {sql_hash_vector("text", DIMENSION)} AS vector, lang AS category,
             'user:' || lang AS scope
      FROM documents),
    asked AS MATERIALIZED (
      SELECT item_id AS query_id, {sql_strip("text")} AS query,
             CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS user_id,
             {sql_hash_vector(sql_strip("text"), DIMENSION)} AS vector
      FROM benchmark),
    scored AS (
      SELECT q.query_id, q.query, q.user_id, m.id, m.text, m.category, m.scope,
             {sql_l2_score("q.vector", "m.vector")} AS score
      FROM asked q, memories m WHERE {visible}),
    ranked AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM scored WHERE score >= {MIN_SCORE})
      WHERE rank <= {K})"""


@query(
    "job_search_batch",
    f"""
    WITH {_sql_search(scoped=False)}
    SELECT a.query_id, a.query, r.rank, r.id, round(r.score, 5) AS score, r.category, r.scope, r.text
    FROM asked a LEFT JOIN ranked r USING (query_id)
    """,
)
def job_search_batch(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = jobs.run_search(
        asked, _memories(spark, sf_dir), EMBEDDER, top_k=K, min_score=MIN_SCORE
    )
    hits = found.select("query_id", "query", F.posexplode_outer("results").alias("at", "hit"))
    return hits.select(
        "query_id",
        "query",
        (F.col("at") + 1).cast("bigint").alias("rank"),
        "hit.id",
        F.round("hit.score", 5).alias("score"),
        "hit.category",
        "hit.scope",
        "hit.text",
    )


def repeat_client():
    """An answering model that repeats its request."""

    def call(sent):
        return "re: " + sent["request"]

    return call


@query(
    "job_eval",
    f"""
    WITH {_sql_search(scoped=True)},
    contexts AS (
      SELECT query_id, string_agg('[' || rank || '] (id=' || id || ', category=' || category || ', scope=' || scope
               || ', score=' || printf('%.3f', score) || ') ' || text, chr(10) ORDER BY rank) AS context,
             string_agg(id, ',' ORDER BY rank) AS context_ids
      FROM ranked GROUP BY query_id),
    items AS (
      SELECT query_id, query AS question, 'truth ' || query_id AS ground_truth, user_id,
             coalesce(context, '') AS context, coalesce(context_ids, '') AS context_ids
      FROM asked LEFT JOIN contexts USING (query_id))
    SELECT *, 're: Question: ' || question || chr(10) || chr(10) || 'Related Memories:' || chr(10) || context
             AS answer, 'direct' AS mode
    FROM items
    UNION ALL
    SELECT query_id, question, ground_truth, user_id, '', '', 'Dry-run agent answer to: ' || question, 'agent'
    FROM items
    """,
)
def job_eval(spark, sf_dir):
    user = F.when(F.col("item_id") % 2 == 0, F.lit("en")).otherwise(F.lit("fr"))
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.concat(F.lit("truth "), F.col("item_id").cast("string")).alias("ground_truth"),
        user.alias("user_id"),
    )
    stored = _memories(spark, sf_dir)
    direct = jobs.run_eval(asked, stored, EMBEDDER, ModelCalls(repeat_client), top_k=K, min_score=MIN_SCORE)
    agent = jobs.run_eval(asked, None, None, DryRun(), agent=True)
    both = direct.withColumn("mode", F.lit("direct")).unionByName(agent.withColumn("mode", F.lit("agent")))
    return both.withColumn("context_ids", F.array_join("context_ids", ","))


# ---------------------------------------------------------------------------------------------- judge


@query(
    "job_judge",
    """
    WITH judged AS (
      SELECT CASE quality WHEN 1 THEN 'CORRECT' ELSE 'WRONG' END AS label,
             quality::DOUBLE AS score, toxic, doc_id
      FROM labels),
    verdicts AS (
      SELECT doc_id, CASE WHEN toxic = 1 THEN 'ERROR' ELSE label END AS label,
             CASE WHEN toxic = 1 THEN 0.0 ELSE score END AS score,
             doc_id % 4 = 0 AS broken
      FROM judged)
    SELECT 'accuracy' AS report, round(avg(score), 9) AS value FROM verdicts
    UNION ALL SELECT 'failures', count(*) FROM verdicts WHERE score < 1.0
    UNION ALL SELECT 'correct', count(*) FROM verdicts WHERE score >= 0.7
    UNION ALL SELECT 'server_errors', count(*) FROM verdicts WHERE broken
    UNION ALL SELECT 'label ' || label, count(*) FROM verdicts GROUP BY label
    """,
)
def job_judge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    answers = labels.join(docs, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("What does "), F.col("doc_id").cast("string"), F.lit(" say?")).alias("question"),
        F.coalesce("text", F.lit("")).alias("ground_truth"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("500 Internal Server Error")).otherwise(F.lit("text")).alias("answer"),
        "quality",
        "toxic",
    )
    label = F.when(F.col("quality") == 1, F.lit("correct")).otherwise(F.lit("Wrong"))
    reply = F.when(F.col("toxic") == 1, F.lit("no verdict")).otherwise(F.to_json(F.struct(label.alias("label"))))
    request = prompts.judge_request("question", "ground_truth", "answer")
    key = inference.request_hash(request, F.lit(prompts.JUDGE_INSTRUCTIONS))
    responses = answers.select(key.alias("request_hash"), reply.alias("response"))
    done = jobs.run_judge(answers, ResponsesTable(responses))
    accuracy = done.accuracy.select(F.lit("accuracy").alias("report"), F.round("accuracy", 9).alias("value"))
    failures = done.failures.agg(F.count(F.lit(1)).cast("double").alias("value"))
    numbers = done.report.selectExpr("double(correct) AS correct", "double(server_errors) AS server_errors")
    counts = numbers.unpivot([], ["correct", "server_errors"], "report", "value")
    by_label = done.results.groupBy(
        F.concat(F.lit("label "), F.upper("judge_result.label")).alias("report")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))
    named = failures.select(F.lit("failures").alias("report"), "value")
    return accuracy.unionByName(named).unionByName(counts).unionByName(by_label)
