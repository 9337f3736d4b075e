"""Model calls over DataFrames: render a request column, call a provider, parse the response column.

A provider adds the columns `response` and `error`; a failed call leaves an error and never fails the job. The five
uses below turn errors into the value each use reports for a failure.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions import prompts, replies
from memoloom.functions.entries import ENTRIES_TYPE, entry, parse_entries
from memoloom.functions.scopes import column_or, path_user, user_scope
from memoloom.operators.lookup import lookup
from memoloom.operators.pacing import Window
from memoloom.schemas import IMPORTANCE_EXTRACTED
from memoloom.workspace import materialized

# Parameters sent with each use, and the results of failed and dry runs.
EXTRACT_PARAMS = {"temperature": 0.2, "max_tokens": 2048}
ANSWER_PARAMS = {"temperature": 0.2, "max_tokens": 512}
JUDGE_PARAMS = {"temperature": 0.0, "max_tokens": 1024}
AGENT_INGEST_PARAMS = {"temperature": 0.7}
FAILED_ANSWER = "Error generating answer"
FAILED_PREFIX = "Error: "
DRY_MEMORY = "Dry-run memory from "
DRY_ANSWER = "Dry-run answer to: "
DRY_REASONING = "Dry-run pass"
DRY_INGEST = "Dry-run ingest: "
SKIPPED_EMPTY = "Skipped: empty text"


class ModelError(Exception):
    """A failed call with the status the service gave, and the seconds it asks to wait for, where it does."""

    def __init__(self, status: int, message: str = "", retry_after: float | None = None):
        super().__init__(message or f"status {status}")
        self.status, self.retry_after = status, retry_after


def worth_retrying(error: Exception) -> bool:
    """Server errors, rate limits and broken connections may pass; anything else will not."""
    status = getattr(error, "status", None)
    if status is not None:
        return status >= 500 or status == 429
    return isinstance(error, (ConnectionError, TimeoutError))


@dataclass(frozen=True)
class Retry:
    """Attempts in all, and the wait before the second, which doubles from then on."""

    attempts: int = 1
    delay: float = 2.0

    def call(self, fn: Callable, *args, sleep=time.sleep):
        delay = self.delay
        for attempt in range(1, self.attempts + 1):
            try:
                return fn(*args)
            except Exception as error:
                if attempt == self.attempts or not worth_retrying(error):
                    raise
                sleep(delay)
                delay *= 2


# Rows that a task has under way at a time, and the replies it hands on at once.
_AHEAD = 256
_PACKED_ROWS, _PACKED_CHARACTERS = 1024, 1 << 20

_LOG = "_key string, response string, error string, run string"
AGENT_RETRY = Retry(attempts=5, delay=2.0)


@dataclass(frozen=True)
class DryRun:
    """No calls; every use fills in its fixed value as a column expression."""


@dataclass(frozen=True)
class ResponsesTable:
    """Answers computed elsewhere: a frame (request_hash, response), one row per request."""

    responses: DataFrame


@dataclass(frozen=True)
class ModelCalls:
    """Calls made from the tasks.

    `make_client()` runs once per task and returns a function of one request dict: system, request, user and the
    parameters of the use. Up to `threads` calls run at a time per task, fewer while the service answers 429 (`pacing.Window`).
    """

    make_client: Callable
    threads: int = 4
    retry: Retry = Retry()


@dataclass(frozen=True)
class LoggedCalls:
    """Calls whose replies are kept in a table at `path`, across runs.

    Equal requests (text, system, user and parameters) are asked once, and only those without a reply in the table. Replies are
    written in slices of about `slice_rows` requests, each committed as a whole: a job that fails, or loses its driver, asks again only
    for the slices that were not written. Failed calls are not kept; the next run asks them again.

    `at_once` limits the calls at a time over the whole cluster: a slice has no more tasks, and a task no more threads, than it allows
    (the copies of tasks that Spark's speculation starts, if it is on, come on top).
    """

    calls: ModelCalls
    path: str
    slice_rows: int = 10_000
    at_once: int | None = None

    def shape(self, cores: int) -> tuple[int, int]:
        """Tasks of a slice, and threads of a task."""
        if self.at_once is None:
            return cores, self.calls.threads
        if self.at_once < 1:
            raise ValueError("at_once must be positive")
        threads = min(self.calls.threads, self.at_once)
        return min(cores, self.at_once // threads), threads


Provider = DryRun | ResponsesTable | ModelCalls | LoggedCalls


def request_hash(request: Column | str, system: Column | str | None = None) -> Column:
    """Key of a request in a responses table."""
    parts = [F.lit("") if system is None else system, F.col(request) if isinstance(request, str) else request]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def infer(
    df: DataFrame,
    provider: ResponsesTable | ModelCalls | LoggedCalls,
    request: Column,
    *,
    system: str = "",
    user: Column | None = None,
    params: dict | None = None,
    retry: Retry | None = None,
) -> DataFrame:
    """`df` with `response` and `error`; null requests are not sent and stay null in both."""
    if isinstance(provider, ResponsesTable):
        return _look_up(df, provider.responses, request_hash(request, F.lit(system)), request)
    sent = F.struct(request.alias("request"), (F.lit(None) if user is None else user).cast("string").alias("user"))
    if isinstance(provider, LoggedCalls):
        tasks, threads = provider.shape(df.sparkSession.sparkContext.defaultParallelism)
        call = _caller(replace(provider.calls, threads=threads), system, dict(params or {}), retry or provider.calls.retry)
        return _from_log(df, provider, sent, json.dumps([system, params or {}], sort_keys=True), call, tasks)
    call = _caller(provider, system, dict(params or {}), retry or provider.retry)
    return df.withColumn("_reply", call(sent)).select("*", "_reply.response", "_reply.error").drop("_reply")


def _from_log(df: DataFrame, provider: LoggedCalls, sent: Column, setting: str, call, tasks: int) -> DataFrame:
    """Ask for what the log lacks, then join its replies back. The calls run here, not with the frame that is returned."""
    spark, log = df.sparkSession, provider.path
    rows = df.withColumn("_sent", sent)
    # a null user and an empty one are different requests
    asked = F.to_json(F.struct(F.lit(setting).alias("setting"), "_sent.request", "_sent.user"))
    rows = rows.withColumn("_key", F.when(F.col("_sent.request").isNotNull(), F.sha2(asked, 256)))
    rows = materialized(rows, "requests")  # the rows that were asked are those that get the replies
    spark.createDataFrame([], _LOG).write.mode("append").parquet(log)
    known = spark.read.schema(_LOG).parquet(log).where("response is not null").select("_key")
    open_ones = rows.where("_key is not null").groupBy("_key").agg(F.first("_sent").alias("_sent"))
    open_ones = materialized(open_ones.join(known, "_key", "left_anti"), "requests-open")
    slices = -(-open_ones.count() // provider.slice_rows)
    run = uuid.uuid4().hex
    for number in range(slices):
        part = open_ones.where(F.pmod(F.xxhash64("_key"), F.lit(slices)) == number)
        # a reply is slow and its request small: the number of tasks is told, whatever the size of the files
        replies = part.repartition(tasks).withColumn("_reply", call(F.col("_sent")))
        replies.select("_key", "_reply.response", "_reply.error", F.lit(run).alias("run")).write.mode("append").parquet(log)
    # of this run all, of others the replies; runs at the same time may have asked the same
    kept = spark.read.schema(_LOG).parquet(log).where((F.col("run") == run) | F.col("response").isNotNull())
    replies = kept.groupBy("_key").agg(F.min("response").alias("response"), F.min("error").alias("error"))
    joined = lookup(rows, replies, "_key", F.xxhash64(*_hashable(df)), "left")
    return joined.select(*df.columns, "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))


def _look_up(df: DataFrame, responses: DataFrame, key: Column, request: Column) -> DataFrame:
    """Left join by request hash; requests that very many rows make are spread over tasks."""
    known = responses.select(F.col("request_hash").alias("_key"), "response")
    asked = df.withColumn("_key", F.when(request.isNotNull(), key))
    joined = lookup(asked, known, "_key", F.xxhash64(*_hashable(df)), "left")
    unanswered = F.col("_key").isNotNull() & F.col("response").isNull()
    error = F.when(unanswered, F.lit("no response for this request"))
    return joined.select(*df.columns, "response", error.alias("error"))


def _hashable(df: DataFrame) -> list[str]:
    """Columns to tell rows apart by, short ones first choice: maps and variants have no hash."""
    plain = [name for name, kind in df.dtypes if kind in ("bigint", "int", "string")]
    numbers = [name for name, kind in df.dtypes if kind in ("bigint", "int")]
    return numbers or plain


def _caller(provider: ModelCalls, system: str, params: dict, retry: Retry):
    @F.arrow_udf("response string, error string")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client, window = provider.make_client(), Window(provider.threads, retry.delay)

        def one(row: dict) -> tuple:
            if row["request"] is None:
                return None, None
            try:
                sent = {"system": system, "request": row["request"], "user": row["user"], **params}
                return retry.call(window.call, client, sent), None
            except Exception as error:
                return None, str(error) or type(error).__name__

        with ThreadPoolExecutor(provider.threads) as pool:
            yield from _packed(_in_order(pool, one, _rows(batches), max(_AHEAD, 4 * provider.threads)))

    return call.asNondeterministic()  # one call for a row, whatever filters the optimizer moves or infers


def _rows(batches: Iterator[pa.Array]) -> Iterator[dict]:
    """The rows of all batches; few of them are Python objects at a time."""
    for batch in batches:
        for start in range(0, len(batch), _AHEAD):
            yield from batch.slice(start, _AHEAD).to_pylist()


def _in_order(pool: ThreadPoolExecutor, fn: Callable, rows: Iterator, ahead: int) -> Iterator:
    """fn of each row, in the order of the rows; at most `ahead` are handed to the pool before the first of them is done."""
    under_way: deque = deque()
    for row in rows:
        under_way.append(pool.submit(fn, row))
        if len(under_way) >= ahead:
            yield under_way.popleft().result()
    while under_way:
        yield under_way.popleft().result()


def _packed(replies: Iterator[tuple]) -> Iterator[pa.Array]:
    """Replies in arrays of at most _PACKED_ROWS rows, fewer where they are long."""

    def array(held: list[tuple]) -> pa.Array:
        columns = [pa.array(values, pa.string(), from_pandas=True) for values in zip(*held, strict=True)]
        return pa.StructArray.from_arrays(columns, ["response", "error"])

    held, size = [], 0
    for reply in replies:
        held.append(reply)
        size += sum(len(value) for value in reply if isinstance(value, str))
        if len(held) >= _PACKED_ROWS or size >= _PACKED_CHARACTERS:
            yield array(held)
            held, size = [], 0
    if held:
        yield array(held)


def _named_user(df: DataFrame, name: str) -> Column:
    return F.nullif(column_or(df, name), F.lit(""))


# ---------------------------------------------------------------------------------------------- the five uses


def extract(
    df: DataFrame,
    provider: Provider,
    *,
    text: str = "text",
    path: str = "path",
    user: str = "user_id",
    system: str = prompts.EXTRACTION_INSTRUCTIONS,
) -> DataFrame:
    """Adds `entries`: the memories a model finds in each text; [] for failures."""
    where = column_or(df, path, "unknown")
    if isinstance(provider, DryRun):
        name = F.when(where.isNull() | (where == ""), F.lit("unknown")).otherwise(F.substring_index(where, "/", -1))
        metadata = F.to_json(F.struct(F.lit("dry-run").alias("source"), where.alias("path")))
        dry = entry(
            F.concat(F.lit(DRY_MEMORY), name),
            F.lit("fact"),
            user_scope(column_or(df, user)),
            F.lit(IMPORTANCE_EXTRACTED),
            metadata,
        )
        return df.withColumn("entries", F.array(dry))
    called = infer(df, provider, F.col(text), system=system, params=EXTRACT_PARAMS)
    found = parse_entries("response", where, column_or(df, user))
    entries = F.when(F.col("error").isNull(), found).otherwise(F.array().cast(ENTRIES_TYPE))
    return called.withColumn("entries", entries).drop("response", "error")


def answer(
    df: DataFrame,
    provider: Provider,
    *,
    question: str = "question",
    context: str = "context",
    system: str = prompts.ANSWER_INSTRUCTIONS,
) -> DataFrame:
    """Adds `answer` from question and context."""
    if isinstance(provider, DryRun):
        return df.withColumn("answer", F.concat(F.lit(DRY_ANSWER), F.coalesce(question, F.lit(""))))
    request = prompts.answer_request(question, column_or(df, context, ""))
    called = infer(df, provider, request, system=system, params=ANSWER_PARAMS)
    given = F.when(F.col("error").isNull(), F.coalesce("response", F.lit(""))).otherwise(F.lit(FAILED_ANSWER))
    return called.withColumn("answer", given).drop("response", "error")


def judge(
    df: DataFrame,
    provider: Provider,
    *,
    system: str = prompts.JUDGE_INSTRUCTIONS,
    template: str = prompts.JUDGE_TEMPLATE,
) -> DataFrame:
    """Adds `judge_result` from question, ground_truth and answer."""
    if isinstance(provider, DryRun):
        passed = replies.verdict(F.lit(replies.CORRECT), F.lit(DRY_REASONING), F.lit(1.0))
        return df.withColumn("judge_result", passed)
    request = prompts.judge_request(
        column_or(df, "question"), column_or(df, "ground_truth"), column_or(df, "answer"), template
    )
    called = infer(df, provider, request, system=system, params=JUDGE_PARAMS)
    failed = replies.verdict(F.lit(replies.ERROR), F.concat(F.lit(FAILED_PREFIX), "error"), F.lit(0.0))
    result = F.when(F.col("error").isNull(), replies.parse_verdict(F.coalesce("response", F.lit(""))))
    return called.withColumn("judge_result", result.otherwise(failed)).drop("response", "error")


def agent_answer(
    df: DataFrame,
    provider: Provider,
    *,
    question: str = "question",
    user: str = "user_id",
    agent: str = "agent",
    params: dict | None = None,
    retry: Retry = AGENT_RETRY,
) -> DataFrame:
    """Adds `answer` from an agent that does its own retrieval; an empty question gets an empty answer."""
    asked = F.nullif(F.coalesce(question, F.lit("")), F.lit(""))
    if isinstance(provider, DryRun):
        return df.withColumn("answer", F.concat(F.lit(f"Dry-run {agent} answer to: "), F.coalesce(question, F.lit(""))))
    called = infer(df, provider, asked, user=_named_user(df, user), params=params or ANSWER_PARAMS, retry=retry)
    given = (
        F.when(asked.isNull(), F.lit(""))
        .when(F.col("error").isNotNull(), F.concat(F.lit(FAILED_PREFIX), "error"))
        .otherwise(replies.response_text("response"))
    )
    return called.withColumn("answer", given).drop("response", "error")


def agent_ingest(
    df: DataFrame, provider: Provider, *, text: str = "text", path: str = "path", user: str = "user_id"
) -> DataFrame:
    """Adds `agent_response`: the status of telling each text to an agent."""
    where = column_or(df, path, "unknown_source")
    if isinstance(provider, DryRun):
        return df.withColumn("agent_response", F.concat(F.lit(DRY_INGEST), where))
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    request = F.when(~empty, prompts.ingest_request(text))
    owner = F.coalesce(_named_user(df, user), path_user(where))
    called = infer(df, provider, request, user=owner, params=AGENT_INGEST_PARAMS)
    status = (
        F.when(empty, F.lit(SKIPPED_EMPTY))
        .when(F.col("error").isNotNull(), F.concat(F.lit(FAILED_PREFIX), "error"))
        .otherwise(prompts.ingest_status(F.coalesce("response", F.lit(""))))
    )
    return called.withColumn("agent_response", status).drop("response", "error")
