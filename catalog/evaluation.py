"""Grading aggregates and the uses of a model, dry and from tables of responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import SQL_ONE_LINE, choice, doc_path, one_line, sql_choice, sql_doc_path, table
from catalog.parsing import SQL_ENTRIES, reply
from memoloom.functions import prompts
from memoloom.functions.entries import flatten_entries
from memoloom.operators import grading, inference
from memoloom.operators.inference import DryRun, ModelCalls, ModelError, ResponsesTable, Retry

# ---------------------------------------------------------------------------------------------- judged answers


def judged(spark, sf_dir):
    """Judged answers made from labels: good ones count 1, bad ones 0, toxic ones have no score or half of one."""
    n = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "left"
    )
    score = (
        F.when((F.col("toxic") == 1) & (n % 2 == 0), F.lit(0.5))
        .when(F.col("toxic") == 1, F.lit(None))
        .otherwise(F.col("quality").cast("double"))
    )
    reasoning = choice(
        n, "No gold answer", "fine", "the answer is EMPTY", F.lit(None).cast("string"), "fine", "No valid gold"
    )
    verdict = F.struct(F.lit("X").alias("label"), reasoning.alias("reasoning"), score.alias("score"))
    return labels.select(
        F.col("doc_id").alias("item_id"),
        F.coalesce("text", F.lit("")).alias("question"),
        choice(n, "500 Internal Server Error", "yes", F.lit(None).cast("string"), "no").alias("answer"),
        F.when(n % 3 != 0, F.col("lang")).alias("user_id"),
        verdict.alias("judge_result"),
    )


SQL_JUDGED = f"""
judged AS (
  SELECT doc_id AS item_id, coalesce(text, '') AS question,
         {sql_choice("doc_id", "'500 Internal Server Error'", "'yes'", "NULL", "'no'")} AS answer,
         CASE WHEN doc_id % 3 <> 0 THEN lang END AS user_id,
         {sql_choice("doc_id", "'No gold answer'", "'fine'", "'the answer is EMPTY'", "NULL", "'fine'",
                     "'No valid gold'")} AS reasoning,
         CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 0.5 WHEN toxic = 1 THEN NULL ELSE quality END::DOUBLE AS score
  FROM labels LEFT JOIN documents USING (doc_id))
"""


@query(
    "agg_accuracy",
    f"""
    WITH {SQL_JUDGED}
    SELECT round(coalesce(avg(score), 0.0), 9) AS accuracy, count(score) AS scored,
           count(*) FILTER (score < 1.0) AS failed FROM judged
    """,
)
def agg_accuracy(spark, sf_dir):
    return grading.accuracy(judged(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "agg_score_report",
    f"""
    WITH {SQL_JUDGED},
    marked AS (
      SELECT coalesce(score, 0.0) >= 0.7 AS good,
             contains(coalesce(answer, ''), '500 Internal Server Error') AS broken,
             contains(coalesce(reasoning, ''), 'No gold') OR contains(coalesce(reasoning, ''), 'No valid gold')
               OR contains(lower(coalesce(reasoning, '')), 'empty') AS missing
      FROM judged),
    counts AS (
      SELECT count(*) AS total, count(*) FILTER (good) AS correct, count(*) FILTER (NOT good) AS wrong,
             count(*) FILTER (broken) AS server_errors, count(*) FILTER (missing) AS missing_ground_truth,
             count(*) FILTER (broken OR missing) AS excluded
      FROM marked)
    SELECT *, round(correct * 100.0::DOUBLE / total, 9) AS correct_pct,
           round(wrong * 100.0::DOUBLE / total, 9) AS wrong_pct,
           round(CASE WHEN total - server_errors - missing_ground_truth > 0
                THEN correct * 100.0::DOUBLE / (total - server_errors - missing_ground_truth) END, 9)
             AS adjusted_accuracy,
           round(CASE WHEN total - excluded > 0 THEN correct * 100.0::DOUBLE / (total - excluded) END, 9)
             AS adjusted_accuracy_distinct
    FROM counts
    """,
)
def agg_score_report(spark, sf_dir):
    report = grading.score_report(judged(spark, sf_dir))
    ratios = ("correct_pct", "wrong_pct", "adjusted_accuracy", "adjusted_accuracy_distinct")
    return report.withColumns({name: F.round(name, 9) for name in ratios})


@query(
    "agg_failures",
    f"""
    WITH {SQL_JUDGED}
    SELECT item_id, coalesce(user_id, 'unknown') AS user_id,
           question, coalesce(reasoning, 'No reasoning') AS reasoning, score
    FROM judged WHERE score < 1.0
    """,
)
def agg_failures(spark, sf_dir):
    return grading.failures(judged(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- model calls


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"), "text", "lang", "source")


def _responses(asked, request, response, system):
    """A table of responses, one per distinct request."""
    key = inference.request_hash(request, F.lit(system))
    hashed = asked.select(key.alias("request_hash"), response.alias("response"))
    return ResponsesTable(hashed.groupBy("request_hash").agg(F.min("response").alias("response")))


def echo_client():
    """A model that repeats its request, is busy for some and refuses others."""
    busy = set()

    def call(sent):
        request = sent["request"]
        if request.startswith("fr"):
            raise ModelError(400, "refused")
        if request.startswith("de") and request not in busy:
            busy.add(request)
            raise ModelError(503)
        return f"{sent['system']}|{sent['user']}|{sent['temperature']}|{request}"

    return call


@query(
    "udf_batch_infer",
    """
    SELECT doc_id, CASE WHEN lang <> 'fr' THEN 'sys|' || source || '|0.5|' || lang || ' ' || text END AS response,
           CASE WHEN lang = 'fr' THEN 'refused' END AS error
    FROM documents
    """,
)
def udf_batch_infer(spark, sf_dir):
    request = F.concat("lang", F.lit(" "), "text")
    provider = ModelCalls(echo_client, threads=4, retry=Retry(attempts=3, delay=0.0))
    docs = table(spark, sf_dir, "documents")
    called = inference.infer(
        docs, provider, request, system="sys", user=F.col("source"), params={"temperature": 0.5}
    )
    return called.select("doc_id", "response", "error")


@query(
    "infer_extract",
    f"""
    WITH {SQL_ENTRIES}
    SELECT 'dry' AS provider, doc_id, 'Dry-run memory from ' || doc_id || '.md' AS text, 'fact' AS category,
           'user:' || lang AS scope, 0.5::DOUBLE AS importance, {sql_doc_path()} AS origin
    FROM documents
    UNION ALL
    SELECT 'table', doc_id, entry_text, category, 'user:' || lang, importance, {sql_doc_path()} FROM entries
    """,
)
def infer_extract(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("user_id", F.col("lang"))
    asked = docs.withColumn("request", F.concat("path", F.lit("\n"), "text"))
    provider = _responses(asked, F.col("request"), reply(), "find")
    dry = inference.extract(docs, DryRun()).withColumn("provider", F.lit("dry"))
    ready = inference.extract(asked, provider, text="request", system="find").withColumn("provider", F.lit("table"))
    both = dry.select("provider", "doc_id", "entries").unionByName(ready.select("provider", "doc_id", "entries"))
    rows = flatten_entries(both, keep=("provider", "doc_id"))
    origin = F.coalesce(F.get_json_object("metadata", "$.source_path"), F.get_json_object("metadata", "$.path"))
    return rows.withColumn("origin", origin).drop("metadata")


@query(
    "infer_answer",
    """
    SELECT doc_id, 'Dry-run answer to: ' || text AS dry_answer,
           CASE WHEN lang = 'de' THEN 'Error generating answer' ELSE source END AS answer
    FROM documents
    """,
)
def infer_answer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("question"), F.col("doc_id").cast("string").alias("context"), "lang", "source"
    )
    known = docs.where("lang <> 'de'")  # requests without a response fail
    provider = _responses(known, prompts.answer_request("question", "context"), F.col("source"), "sys")
    dry = inference.answer(docs, DryRun()).withColumnRenamed("answer", "dry_answer")
    return inference.answer(dry, provider, system="sys").select("doc_id", "dry_answer", "answer")


@query(
    "infer_judge",
    """
    SELECT doc_id, 'CORRECT' AS dry_label, 'Dry-run pass' AS dry_reasoning, 1.0::DOUBLE AS dry_score,
           CASE lang WHEN 'de' THEN 'ERROR' WHEN 'en' THEN 'CORRECT' ELSE 'WRONG' END AS label,
           CASE lang WHEN 'de' THEN 'Error: no response for this request' ELSE source END AS reasoning,
           CASE lang WHEN 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS score
    FROM documents
    """,
)
def infer_judge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("question"),
        F.col("doc_id").cast("string").alias("answer"),
        F.col("source").alias("ground_truth"),
        "lang",
    )
    label = F.when(F.col("lang") == "en", F.lit("CORRECT")).otherwise(F.lit("WRONG"))
    response = F.to_json(F.struct(label.alias("label"), F.col("ground_truth").alias("reasoning")))
    request = prompts.judge_request("question", "ground_truth", "answer")
    provider = _responses(docs.where("lang <> 'de'"), request, response, prompts.JUDGE_INSTRUCTIONS)
    dry = inference.judge(docs, DryRun()).withColumnRenamed("judge_result", "dry")
    return inference.judge(dry, provider).select(
        "doc_id",
        F.col("dry.label").alias("dry_label"),
        F.col("dry.reasoning").alias("dry_reasoning"),
        F.col("dry.score").alias("dry_score"),
        "judge_result.*",
    )


def agent_client():
    """An agent that wraps its answer the way agents do, and fails for some requests."""
    import json

    def call(sent):
        if sent["request"].startswith(("D", "E")):
            raise ModelError(404, "no such session")
        text = {"type": "output_text", "text": f"{sent['user']}: {sent['request']}"}
        return json.dumps({"output": [{"type": "message", "content": [text]}]})

    return call


@query(
    "infer_agent_answer",
    """
    SELECT doc_id, 'Dry-run agent answer to: ' || question AS dry_answer,
           CASE WHEN question = '' THEN '' WHEN substr(question, 1, 1) IN ('D', 'E') THEN 'Error: no such session'
                ELSE source || ': ' || question END AS answer
    FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS question FROM documents)
    """,
)
def infer_agent_answer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise(F.lit("")).alias("question"),
        F.col("source").alias("user_id"),
    )
    dry = inference.agent_answer(docs, DryRun()).withColumnRenamed("answer", "dry_answer")
    answered = inference.agent_answer(dry, ModelCalls(agent_client))
    return answered.select("doc_id", "dry_answer", "answer")


def status_client():
    def call(sent):
        return f"{sent['user']} {sent['request']}"

    return call


@query(
    "infer_agent_ingest",
    f"""
    WITH told AS (
      SELECT *, {sql_doc_path()} AS path, CASE WHEN doc_id % 5 <> 0 THEN {SQL_ONE_LINE} ELSE '' END AS body
      FROM documents)
    SELECT doc_id, 'Dry-run ingest: ' || path AS dry_response,
           CASE WHEN body = '' THEN 'Skipped: empty text'
                ELSE 'Ingested via chat. Response: '
                  || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'user_' || substr(md5(path), 1, 8) END
                    || ' [remember what''s said, keep existing memory]' || chr(10) || chr(10) || body END AS agent_response
    FROM told
    """,
)
def infer_agent_ingest(spark, sf_dir):
    n = F.col("doc_id")
    docs = _docs(spark, sf_dir).select(
        "doc_id",
        "path",
        F.when(n % 5 != 0, one_line("text")).otherwise(F.lit("")).alias("text"),
        F.when(n % 2 == 0, F.col("source")).alias("user_id"),
    )
    dry = inference.agent_ingest(docs, DryRun()).withColumnRenamed("agent_response", "dry_response")
    told = inference.agent_ingest(dry, ModelCalls(status_client))
    return told.select("doc_id", "dry_response", "agent_response")
