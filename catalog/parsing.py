"""Parsers over frames of files, lines and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    SQL_ONE_LINE,
    choice,
    doc_files,
    doc_path,
    one_line,
    sql_choice,
    sql_doc_path,
    sql_strip,
    table,
)
from memoloom.functions import prompts
from memoloom.functions.entries import parse_entries
from memoloom.functions.replies import parse_verdict, response_text
from memoloom.functions.text import explode_lines
from memoloom.sources import json_array, parsers, sessions
from memoloom.workspace import fresh_path


def _meta(name: str):
    return F.get_json_object("metadata", f"$.{name}")


# ---------------------------------------------------------------------------------------------- files and lines


@query(
    "src_lines",
    f"""
    SELECT doc_id, {sql_strip("line")} AS line
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text,
            '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM documents)
    WHERE {sql_strip("line")} <> ''
    """,
)
def src_lines(spark, sf_dir):
    return explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "src_markdown",
    f"""
    SELECT {sql_doc_path()} AS source_path, {sql_strip("text")} AS text, 'global' AS scope,
           {sql_choice("doc_id", "'preference'", "'fact'", "'entity'", "'other'")} AS category,
           CASE WHEN doc_id % 4 = 3 THEN 0.7 ELSE 0.8 END::DOUBLE AS importance,
           'markdown' AS source, {sql_doc_path()} AS meta_path
    FROM documents WHERE {sql_strip("text")} <> ''
    """,
)
def src_markdown(spark, sf_dir):
    rows = parsers.parse_markdown(doc_files(spark, sf_dir))
    return rows.select(
        "source_path",
        "text",
        "scope",
        "category",
        "importance",
        _meta("source").alias("source"),
        _meta("source_path").alias("meta_path"),
    )


@query(
    "src_plaintext",
    f"""
    SELECT {sql_doc_path("'.txt'")} AS source_path, {sql_strip("text")} AS text, 'global' AS scope,
           'other' AS category, 0.6::DOUBLE AS importance, 'text' AS source
    FROM documents WHERE {sql_strip("text")} <> ''
    """,
)
def src_plaintext(spark, sf_dir):
    rows = parsers.parse_text(doc_files(spark, sf_dir, ".txt"))
    return rows.select("source_path", "text", "scope", "category", "importance", _meta("source").alias("source"))


def _jsonl_lines(spark, sf_dir):
    """One JSON line per document in six shapes: full, content only, raw metadata, own source, broken, no text."""
    text, n = one_line("text"), F.col("doc_id")
    lines = choice(
        n,
        F.to_json(F.struct(text.alias("text"), F.col("lang").alias("category"), F.col("n_chars").alias("timestamp"))),
        F.to_json(F.struct(F.lit("").alias("text"), text.alias("content"), F.lit("0.25").alias("importance"))),
        F.to_json(F.struct(text.alias("text"), F.col("source").alias("metadata"), F.lit("user:7").alias("scope"))),
        F.to_json(
            F.struct(
                text.alias("text"),
                F.struct(F.lit("own").alias("source"), F.col("lang").alias("lang")).alias("metadata"),
                n.cast("string").alias("id"),
                F.lit("2023-10-01").alias("timestamp"),
            )
        ),
        F.concat(F.lit('{"text": "'), text),
        F.to_json(F.struct(F.lit("  ").alias("text"), F.col("lang").alias("category"))),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), F.col("source"), F.lit(".jsonl")).alias("path"), lines.alias("line")
    )


@query(
    "src_jsonl",
    f"""
    SELECT '/in/' || source || '.jsonl' AS source_path, {sql_strip(SQL_ONE_LINE)} AS text,
           CASE WHEN doc_id % 6 = 0 THEN lang ELSE 'other' END AS category,
           CASE WHEN doc_id % 6 = 2 THEN 'user:7' ELSE 'global' END AS scope,
           CASE WHEN doc_id % 6 = 1 THEN 0.25 ELSE 0.7 END::DOUBLE AS importance,
           CASE WHEN doc_id % 6 = 3 THEN doc_id::VARCHAR END AS id,
           CASE doc_id % 6 WHEN 0 THEN n_chars WHEN 3 THEN 1696118400000 END::VARCHAR AS timestamp,
           CASE WHEN doc_id % 6 = 3 THEN 'own' ELSE 'jsonl' END AS source,
           CASE WHEN doc_id % 6 = 2 THEN source END AS metadata_raw,
           CASE WHEN doc_id % 6 = 3 THEN lang END AS lang,
           '/in/' || source || '.jsonl' AS meta_path
    FROM documents WHERE doc_id % 6 < 4 AND {sql_strip(SQL_ONE_LINE)} <> ''
    """,
)
def src_jsonl(spark, sf_dir):
    rows = parsers.parse_jsonl(_jsonl_lines(spark, sf_dir))
    return rows.select(
        "source_path",
        "text",
        "category",
        "scope",
        "importance",
        "id",
        F.col("timestamp").cast("string").alias("timestamp"),
        _meta("source").alias("source"),
        _meta("metadata_raw").alias("metadata_raw"),
        _meta("lang").alias("lang"),
        _meta("source_path").alias("meta_path"),
    )


ITEMS_PER_RESULT_FILE = 48


def _result_files(spark, sf_dir):
    """Files of 48 graded questions made from consecutive documents."""
    n = F.col("doc_id")
    item = F.to_json(
        F.struct(
            F.col("lang").alias("category"),
            n.alias("question_index"),
            F.col("text").alias("question"),
            F.when(n % 5 != 0, F.concat(F.lit(" "), F.col("source"))).alias("ground_truth"),
            F.when(n % 6 != 0, (n % 4) / 4.0).alias("score"),
        )
    )
    number = F.floor(n / ITEMS_PER_RESULT_FILE)
    items = table(spark, sf_dir, "documents").select(number.alias("number"), n.alias("at"), item.alias("item"))
    files = items.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("items"))
    return files.select(
        F.concat(F.lit("/in/result_"), F.col("number").cast("string"), F.lit(".json")).alias("path"),
        F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")).alias("text"),
    )


@query(
    "src_result_json",
    f"""
    WITH items AS (
      SELECT *, doc_id // {ITEMS_PER_RESULT_FILE} AS number,
             CASE WHEN doc_id % 6 <> 0 THEN ((doc_id % 4) / 4.0)::DOUBLE END AS score,
             CASE WHEN doc_id % 5 <> 0 THEN source END AS truth
      FROM documents)
    SELECT 'Graded item ' || doc_id || ' of R' || number || ' (' || lang || ').'
             || CASE WHEN {sql_strip("text")} <> '' THEN ' Question: ' || {sql_strip("text")} ELSE '' END
             || coalesce(' Ground Truth: ' || truth, '')
             || coalesce(' Graded with ' || score || '.', '') AS text,
           'fact' AS category, 'global' AS scope, 0.6::DOUBLE AS importance,
           'result' AS source, '/in/result_' || number || '.json' AS meta_path, 'R' || number AS record_id,
           doc_id::VARCHAR AS question_index, lang AS category_raw, score::VARCHAR AS score,
           'R' || number || ', ' || lang || ', graded item' AS keywords_line
    FROM items WHERE {sql_strip("text")} <> '' OR truth IS NOT NULL
    """,
)
def src_result_json(spark, sf_dir):
    rows = parsers.parse_results(_result_files(spark, sf_dir))
    return rows.select(
        "text",
        "category",
        "scope",
        "importance",
        _meta("source").alias("source"),
        _meta("source_path").alias("meta_path"),
        _meta("record_id").alias("record_id"),
        _meta("question_index").alias("question_index"),
        _meta("category_raw").alias("category_raw"),
        _meta("score").alias("score"),
        _meta("keywords_line").alias("keywords_line"),
    )


@query(
    "src_format_dispatch",
    f"""
    SELECT {sql_choice("doc_id", "'markdown'", "'markdown'", "'jsonl'", "'result'", "'text'", "'text'", "'text'")}
             AS source, count(*) AS memories,
           sum(length(CASE WHEN doc_id % 7 = 3
                           THEN 'Graded item None of R1 (' || lang || '). Question: '
                                || {sql_strip(SQL_ONE_LINE)}
                           ELSE {sql_strip(SQL_ONE_LINE)} END))::BIGINT AS characters
    FROM documents WHERE {sql_strip(SQL_ONE_LINE)} <> '' GROUP BY 1
    """,
)
def src_format_dispatch(spark, sf_dir):
    n = F.col("doc_id")
    suffix = choice(n, ".md", ".MarkDown", ".JSONL", "/result_1.json", "/other.json", ".txt", ".log")
    text = one_line("text")
    content = choice(
        n,
        *[text] * 2,
        F.to_json(F.struct(text.alias("text"))),
        F.concat(
            F.lit("[5,"), F.to_json(F.struct(F.col("lang").alias("category"), text.alias("question"))), F.lit("]")
        ),
        *[text] * 3,
    )
    files = table(spark, sf_dir, "documents").select(doc_path(suffix).alias("path"), content.alias("text"))
    payloads = parsers.parse_files(files)
    return payloads.groupBy(_meta("source").alias("source")).agg(
        F.count(F.lit(1)).alias("memories"), F.sum(F.length("text")).alias("characters")
    )


# ---------------------------------------------------------------------------------------------- workbooks

# A sample takes 32 turns of a conversation, a session four of them, so that both stay small however long it is.
TURNS_PER_SAMPLE = 32
TURNS_PER_SESSION = 4


def samples(spark, sf_dir):
    """Session workbooks made from conversations: (sample, content), the content being JSON.

    Sessions are numbered 1, 4, 7, 10, ...; every second sample keeps them beside its other fields, without a
    `conversation` object, and every third session has no date.
    """
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / TURNS_PER_SAMPLE)).alias("sample"),
        (F.floor(F.col("turn") % TURNS_PER_SAMPLE / TURNS_PER_SESSION) * 3 + 1).alias("session"),
        "turn",
        "role",
        "text",
    )
    listed = turns.groupBy("sample", "session").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("turns")
    )
    key = F.concat(F.lit('"session_'), F.col("session").cast("string"))
    dated = F.concat(key, F.lit('_date_time":"day '), F.col("session").cast("string"), F.lit('",'))
    date = F.when(F.col("sample") % 3 != 0, dated)
    content = F.concat(F.coalesce(date, F.lit("")), key, F.lit('":'), F.to_json("turns"))
    grouped = listed.select("sample", content.alias("content")).groupBy("sample").agg(
        F.array_join(F.array_sort(F.collect_list("content")), ",").alias("content")
    )
    body = F.concat(F.lit("{"), F.col("content"), F.lit("}"))
    nested = F.concat(F.lit('{"session_note":"x","conversation":'), body, F.lit(',"other":1}'))
    return grouped.select(
        F.col("sample"), F.when(F.col("sample") % 2000 == 0, nested).otherwise(body).alias("content")
    )


SQL_SESSIONS = f"""
sessions AS (
  SELECT sample, session, 'user_' || sample AS user_id, 'sessions/user_' || sample || '/session_' || session AS path,
         CASE WHEN sample % 3 <> 0 THEN 'day ' || session ELSE '' END AS timestamp,
         CASE WHEN sample % 3 <> 0 THEN '[Session Date: day ' || session || ']' || chr(10) ELSE '' END
           || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
  FROM (SELECT *, conv_id * 1000 + turn // {TURNS_PER_SAMPLE} AS sample,
               turn % {TURNS_PER_SAMPLE} // {TURNS_PER_SESSION} * 3 + 1 AS session FROM conversations)
  GROUP BY sample, session)
"""


def _read_back(books):
    """(sample, content) written as workbook files, arrays of samples that name themselves, and read from there."""
    path = fresh_path(books.sparkSession, "workbooks")
    named = F.concat(F.lit('{"sample_id":'), F.col("sample").cast("string"), F.lit(","), F.expr("substr(content, 2)"))
    json_array.write_arrays_of(books.select(named), path)
    found = sessions.read_workbooks(books.sparkSession, [path], suffix=None)
    return found.select(F.get_json_object("content", "$.sample_id").cast("bigint").alias("sample"), "content")


@query("src_sessions", f"WITH {SQL_SESSIONS} SELECT * FROM sessions")
def src_sessions(spark, sf_dir):
    rows = sessions.sessions(_read_back(samples(spark, sf_dir)))
    return rows.withColumn("session", F.col("session").cast("bigint"))


@query(
    "src_qa",
    """
    SELECT item_id AS sample, position,
           CASE position WHEN 0 THEN text ELSE 'How many characters has passage ' || item_id || '?' END AS question,
           CASE WHEN position = 1 THEN length(text)::VARCHAR WHEN item_id % 3 = 0 THEN NULL ELSE 'answer ' || item_id
             END AS ground_truth,
           CASE WHEN position = 0 THEN 'D' || item_id || ':1,D' || item_id || ':2' END AS evidence,
           CASE WHEN position = 1 THEN '2' END AS category, 'user_' || item_id AS user_id
    FROM benchmark, range(2) t(position)
    """,
)
def src_qa(spark, sf_dir):
    item = F.col("item_id").cast("string")
    first = F.struct(
        F.col("text").alias("question"),
        F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("answer "), item)).alias("answer"),
        F.array(F.concat(F.lit("D"), item, F.lit(":1")), F.concat(F.lit("D"), item, F.lit(":2"))).alias("evidence"),
    )
    second = F.struct(
        F.concat(F.lit("How many characters has passage "), item, F.lit("?")).alias("question"),
        F.length("text").alias("answer"),
        F.lit(2).alias("category"),
    )
    content = F.concat(F.lit('{"qa":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]}"))
    books = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample"), content.alias("content"))
    rows = sessions.questions(_read_back(books))
    return rows.withColumns(
        {"evidence": F.array_join("evidence", ","), "position": F.col("position").cast("bigint")}
    )


# ---------------------------------------------------------------------------------------------- model replies

FENCE = "```"


def _reply_entries():
    """JSON array of doc_id % 4 entries with varying metadata."""
    n = F.col("doc_id")
    first = F.to_json(F.struct(F.col("text"), F.lit("fact").alias("category"), F.lit(0.9).alias("importance")))
    second = F.to_json(
        F.struct(F.col("lang").alias("text"), F.struct(F.col("source").alias("keywords_line")).alias("metadata"))
    )
    third = F.to_json(F.struct(n.alias("text"), F.col("source").alias("metadata"), F.lit("s").alias("scope")))
    listed = choice(
        n,
        F.lit("[]"),
        F.concat(F.lit("["), first, F.lit("]")),
        F.concat(F.lit('[5,"x",'), first, F.lit(",null,"), second, F.lit("]")),
        F.concat(F.lit("["), first, F.lit(","), second, F.lit(","), third, F.lit("]")),
    )
    return listed


def reply():
    """Model replies: plain, fenced, cut off, an object instead of an array, or two lines of a fence only."""
    listed = _reply_entries()
    fenced = F.concat(F.lit(f" {FENCE}json\r\n"), listed, F.lit(f"\n{FENCE}\n"))
    return choice(
        F.floor(F.col("doc_id") / 4),
        listed,
        fenced,
        fenced,
        F.concat(F.lit("["), listed),
        F.concat(F.lit('{"entries": '), listed, F.lit("}")),
        F.concat(F.lit(f"{FENCE}\n"), listed),
        fenced,
    )


SQL_ENTRIES = """
entries AS (
  SELECT doc_id, k,
         CASE k WHEN 0 THEN text WHEN 1 THEN lang ELSE doc_id::VARCHAR END AS entry_text,
         CASE k WHEN 0 THEN 'fact' END AS category,
         CASE k WHEN 2 THEN 's' END AS scope,
         CASE k WHEN 0 THEN 0.9 END::DOUBLE AS importance,
         CASE k WHEN 1 THEN source END AS keywords_line,
         CASE k WHEN 2 THEN source END AS metadata_raw,
         lang
  FROM documents, range(3) t(k)
  WHERE k < doc_id % 4 AND (doc_id // 4) % 7 IN (0, 1, 2, 6))
"""


@query(
    "fn_parse_entries",
    f"""
    WITH {SQL_ENTRIES}
    SELECT doc_id, k AS position, entry_text AS text, category, scope, importance, keywords_line, metadata_raw,
           'p' || doc_id AS source_path
    FROM entries
    """,
)
def fn_parse_entries(spark, sf_dir):
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    parsed = table(spark, sf_dir, "documents").select("doc_id", parse_entries(reply(), path).alias("entries"))
    rows = parsed.select("doc_id", F.posexplode("entries").alias("position", "e")).select("doc_id", "position", "e.*")
    return rows.select(
        "doc_id",
        F.col("position").cast("bigint").alias("position"),
        "text",
        "category",
        "scope",
        "importance",
        _meta("keywords_line").alias("keywords_line"),
        _meta("metadata_raw").alias("metadata_raw"),
        _meta("source_path").alias("source_path"),
    )


@query(
    "fn_parse_verdict",
    """
    SELECT doc_id,
           CASE k WHEN 0 THEN 'CORRECT' WHEN 1 THEN ' wrong ' WHEN 2 THEN 'Partly' WHEN 3 THEN NULL
                  WHEN 4 THEN 'WRONG' ELSE 'ERROR' END AS label,
           CASE k WHEN 0 THEN text WHEN 1 THEN lang WHEN 2 THEN NULL WHEN 3 THEN source
                  WHEN 4 THEN 'Invalid JSON: ["' || lang || '"]'
                  ELSE 'JSON Decode Error: CORRECT ' || text END AS reasoning,
           CASE k WHEN 0 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN NULL ELSE 0.0 END::DOUBLE AS score
    FROM (SELECT *, doc_id % 6 AS k FROM documents)
    """,
)
def fn_parse_verdict(spark, sf_dir):
    replies = choice(
        F.col("doc_id"),
        F.concat(
            F.lit(f"{FENCE}json\n"),
            F.to_json(F.struct(F.lit("CORRECT").alias("label"), F.col("text").alias("reasoning"))),
            F.lit(f"\n{FENCE}"),
        ),
        F.to_json(F.struct(F.lit(" wrong ").alias("label"), F.col("lang").alias("reasoning"), F.lit(1).alias("score"))),
        F.lit('{"label": "Partly", "score": 0.5}'),
        F.to_json(F.struct(F.col("source").alias("reasoning"), F.lit("high").alias("score"))),
        F.concat(F.lit('["'), F.col("lang"), F.lit('"]')),
        F.concat(F.lit("CORRECT "), F.col("text")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", parse_verdict(replies).alias("v")).select("doc_id", "v.*")


@query(
    "fn_response_text",
    """
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN lang WHEN 2 THEN source WHEN 3 THEN ''
                     WHEN 4 THEN '{"output":[],"id":"' || source || '"}' ELSE lang || ' is no JSON' END AS answer
    FROM documents
    """,
)
def fn_response_text(spark, sf_dir):
    def part(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def item(kind, parts=None, text=None):
        none = F.array().cast("array<struct<type:string,text:string>>")
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
            (none if parts is None else F.array(*parts)).alias("content"),
        )

    def output(*items):
        return F.to_json(F.struct(F.array(*items).alias("output")))

    missing = F.lit(None).cast("string")
    responses = choice(
        F.col("doc_id"),
        output(
            item("reasoning", text=F.lit("thinking")),
            item("message", [part("note", F.lit("no")), part("output_text", F.col("text"))]),
            item("message", [part("output_text", F.lit("later"))]),
        ),
        output(item("message", [part("note", missing)]), item("tool", text=F.col("lang"))),
        output(item("tool", [part("note", missing), part("note", F.col("source"))]), item("tool", text=F.lit("x"))),
        output(item("message", [part("output_text", missing)]), item("tool", text=F.lit("x"))),
        F.concat(F.lit('{"output":[],"id":"'), F.col("source"), F.lit('"}')),
        F.concat(F.col("lang"), F.lit(" is no JSON")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", response_text(responses).alias("answer"))


@query(
    "fn_render_prompt",
    """
    SELECT doc_id,
           'Question: ' || lang || chr(10) || chr(10) || 'Related Memories:' || chr(10) || text AS answer_request,
           '{' || lang || '} ' || source || ' = ' || text || ' {answer}' AS judge_request,
           '[remember what''s said, keep existing memory]' || chr(10) || chr(10) || text AS ingest_request,
           'Ingested via chat. Response: ' || text AS ingest_status
    FROM documents
    """,
)
def fn_render_prompt(spark, sf_dir):
    template = "{{{question}}} {ground_truth} = {answer} {{answer}}"
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        prompts.answer_request("lang", "text").alias("answer_request"),
        prompts.judge_request("lang", "source", "text", template).alias("judge_request"),
        prompts.ingest_request("text").alias("ingest_request"),
        prompts.ingest_status("text").alias("ingest_status"),
    )
