"""The five jobs: import, ingest, search, evaluate, judge. Each is one lazy plan up to the table it writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.functions.entries import materialize, normalize_entries
from memoloom.functions.text import is_blank, strip
from memoloom.operators import grading, inference
from memoloom.operators.context import attach_context
from memoloom.operators.embedding import Embedder, embed
from memoloom.operators.search import align, search_batch
from memoloom.sources import files, memory_table, parsers, sessions
from memoloom.sources.array_splits import array_elements
from memoloom.workspace import materialized


def store(
    payloads: DataFrame, embedder: Embedder, path: str, now_ms: int, mode: str = "pro", run_key: str | None = None
) -> int:
    """Embed payloads, fill ids and times, append to the memory table at `path`; returns the number of rows.

    With a `run_key` the table is a keyed one, and a repeated job replaces its own rows (`memory_table.append`).
    """
    memory_table.create_table(payloads.sparkSession, path, embedder.dimensions, mode, keyed=run_key is not None)
    return memory_table.append(materialize(embed(payloads, embedder), now_ms), path, run_key)


def import_payloads(
    spark: SparkSession,
    paths: list[str],
    input_format: str = "auto",
    max_items: int | None = None,
    wording: parsers.ResultWording = parsers.ResultWording(),
) -> DataFrame:
    """Payloads of all files below `paths`.

    Every format opens its own files only, JSON lines in splits; graded results too when their format is given, else a file is
    one value. The files are listed once per way of reading.
    """
    if input_format not in (*parsers.FORMATS, "auto"):
        raise ValueError(f"unsupported input format: {input_format}")

    def chosen(df: DataFrame, fmt: str) -> DataFrame:
        return df.where(parsers.file_format("file", wording) == fmt) if input_format == "auto" else df

    binary = files.scan_files(spark, paths) if input_format not in ("jsonl", "result") else None

    def whole(fmt: str) -> DataFrame:
        found = chosen(binary, fmt)
        return found.select(F.col("file").alias("path"), files.decoded("content").alias("text"))

    def lines() -> DataFrame:
        found = chosen(files.scan_lines(spark, paths), "jsonl")
        return found.select(F.col("file").alias("path"), F.col("value").alias("line"))

    def results() -> DataFrame:
        if input_format == "auto":  # one scan per format, no shuffle
            return parsers.parse_results(whole("result"), max_items, wording)
        return parsers.parse_result_elements(array_elements(spark, paths), max_items, wording)

    branches = {
        "markdown": lambda: parsers.parse_markdown(whole("markdown")),
        "jsonl": lambda: parsers.parse_jsonl(lines()),
        "result": results,
        "text": lambda: parsers.parse_text(whole("text")),
    }
    if input_format != "auto":
        return branches[input_format]()
    return parsers.union_payloads([branch() for branch in branches.values()])


def run_import(
    spark: SparkSession,
    paths: list[str],
    table_path: str,
    embedder: Embedder,
    now_ms: int,
    input_format: str = "auto",
    mode: str = "pro",
    run_key: str | None = None,
    **options,
) -> int:
    """Structured files to the memory table; returns the number of memories."""
    return store(import_payloads(spark, paths, input_format, **options), embedder, table_path, now_ms, mode, run_key)


def _is_workbook(paths: list[str], selected: bool, mark: str | None) -> bool:
    """One JSON file is a session workbook when samples, sessions or a user are chosen, or its path says so."""
    if len(paths) != 1 or not paths[0].lower().endswith(".json"):
        return False
    return selected or bool(mark and mark.lower() in paths[0].lower())


def ingest_texts(
    spark: SparkSession,
    paths: list[str],
    *,
    sample_range: str | None = None,
    session_range: str | None = None,
    user: str | None = None,
    workbook_mark: str | None = None,
) -> DataFrame:
    """text, path, user_id to ingest: the session transcripts of a workbook, the objects of JSON-lines files (text, path,
    user_id), or whole conversation files."""
    if _is_workbook(paths, bool(sample_range or session_range or user), workbook_mark):
        books = sessions.read_workbooks(spark, paths)
        found = sessions.sessions(books, sample_range=sample_range, session_range=session_range, user=user)
        return found.select("text", "path", "user_id")
    whole = files.read_texts(spark, paths, suffix=r"(?i)\.(txt|md|markdown)$")
    whole = whole.select("text", "path", F.lit(user).cast("string").alias("user_id"))
    lines = sessions.text_lines(files.read_json_lines(spark, paths), user)
    return whole.unionByName(lines.select("text", "path", "user_id"))


def eval_questions(
    spark: SparkSession,
    path: str,
    *,
    sample_range: str | None = None,
    user: str | None = None,
    workbook_mark: str | None = None,
) -> DataFrame:
    """Questions of a workbook, or one per line of a file: JSON objects or plain text."""
    if _is_workbook([path], bool(sample_range or user), workbook_mark):
        return sessions.questions(sessions.read_workbooks(spark, [path]), sample_range=sample_range, user=user)
    return sessions.question_lines(files.read_lines(spark, [path]), user)


def extracted_payloads(texts: DataFrame, provider: inference.Provider, **options) -> DataFrame:
    """Payloads a model finds in (text, path, user_id) rows."""
    found = inference.extract(texts, provider, **options)
    numbered = found.select("path", F.posexplode_outer("entries").alias("position", "_entry")).where("_entry is not null")
    return normalize_entries(numbered.select(F.col("path").alias("source_path"), "position", "_entry.*"))


def run_ingest(
    texts: DataFrame,
    provider: inference.Provider,
    table_path: str,
    embedder: Embedder,
    now_ms: int,
    mode: str = "pro",
    run_key: str | None = None,
    **options,
) -> int:
    """Texts (text, path, user_id), e.g. session transcripts, to extracted memories in the memory table."""
    payloads = extracted_payloads(texts, provider, **options)
    if not isinstance(provider, inference.DryRun):
        payloads = materialized(payloads, "extracted")  # model replies are kept, whatever happens to the append
    return store(payloads, embedder, table_path, now_ms, mode, run_key)


def run_agent_ingest(texts: DataFrame, provider: inference.Provider, **options) -> DataFrame:
    """One status row (agent_response) per text told to an agent."""
    return inference.agent_ingest(texts, provider, **options).select("agent_response")


def run_search(
    queries: DataFrame, memories: DataFrame, embedder: Embedder, **options
) -> DataFrame:
    """query_id, query, results for every query (query_id, query, optional user_id); no hits give []."""
    kept = [c for c in ("query_id", "query", "user_id") if c in queries.columns]
    asked = queries.select(*kept).withColumn("query", strip("query"))
    return align(asked, search_batch(asked, memories, embedder, **options))


def with_query_id(questions: DataFrame, name: str = "query_id") -> DataFrame:
    """Questions with a key of their own, for inputs that bring none.

    Row numbers may differ when a lost partition is computed again, so they are written down once.
    """
    if name in questions.columns:
        return questions
    return materialized(questions.withColumn(name, F.monotonically_increasing_id()), "questions")


def run_eval(
    questions: DataFrame,
    memories: DataFrame | None,
    embedder: Embedder | None,
    provider: inference.Provider,
    *,
    agent: bool = False,
    agent_options: dict | None = None,
    **search_options,
) -> DataFrame:
    """Questions with context, context_ids and answer; all their own columns are carried through.

    With `agent` the answer comes from an agent that retrieves by itself, and the context stays empty.
    """
    asked = with_query_id(questions.where(~is_blank("question")))
    if agent:
        empty = asked.withColumns({"context": F.lit(""), "context_ids": F.array().cast("array<string>")})
        return inference.agent_answer(empty, provider, **(agent_options or {}))
    queries = asked.withColumnRenamed("question", "query")
    kept = [c for c in ("query_id", "query", "user_id") if c in queries.columns]
    hits = search_batch(queries.select(*kept), memories, embedder, **search_options)
    return inference.answer(attach_context(asked, hits), provider)


@dataclass(frozen=True)
class Judged:
    """What the judge job leaves: the judged answers and the three reports over them."""

    results: DataFrame
    accuracy: DataFrame
    failures: DataFrame
    report: DataFrame


def run_judge(answers: DataFrame, provider: inference.Provider, **options) -> Judged:
    """Grade answers once and report on the stored verdicts."""
    results = materialized(inference.judge(answers, provider, **options), "judged")
    return Judged(results, grading.accuracy(results), grading.failures(results), grading.score_report(results))
