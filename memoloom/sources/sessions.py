"""Session workbooks: JSON samples with numbered chat sessions and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memoloom.functions.ranges import filter_numbers
from memoloom.functions.scopes import sample_user, session_path
from memoloom.functions.text import clean_text
from memoloom.functions.columns import col
from memoloom.operators.context import transcript_of
from memoloom.sources.array_splits import BLOCK_BYTES, array_elements

_MAP = "map<string,string>"
_TURNS = "array<struct<speaker:string,text:string>>"
NUMBERS_PER_STRETCH = 4096
_SESSION = r"^session_([0-9]+)$"


def split_workbooks(files: DataFrame) -> DataFrame:
    """path, sample (0-based) and content of every sample in (path, text) workbooks.

    A workbook holds an array of samples, or one sample on its own. One file is one row up to here, so the samples
    are spread over the tasks afterwards.
    """
    samples = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    rows = files.select("path", F.posexplode(samples).alias("sample", "content"))
    return rows.repartition("path", "sample")


def read_workbooks(spark: SparkSession, paths: list[str], suffix: str | None = r"(?i)\.json$", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, sample (0-based) and content of every sample of the workbook files: arrays of samples, read by byte ranges, so
    one file is no limit; or one sample a file. A file whose brackets do not close gives nothing; bytes that are no UTF-8 make
    a null content."""
    found = array_elements(spark, paths, suffix, single=True, block_bytes=block_bytes)
    content = F.try_validate_utf8(F.col("element").cast("string"))
    return found.select("path", F.col("position").cast("int").alias("sample"), content.alias("content"))


def sessions(
    samples: DataFrame,
    *,
    sample_range: str | None = None,
    session_range: str | None = None,
    user: str | None = None,
    user_prefix: str = "user_",
    path_root: str = "sessions",
) -> DataFrame:
    """One transcript per session of (sample, content): sample, session, text, path, user_id, timestamp.

    Sample numbers start at 0, session numbers at 1; ranges such as '1-4' select among them.
    """
    chosen = filter_numbers(samples, "sample", sample_range)
    fields = chosen.select("sample", F.from_json("content", _MAP).alias("m"))
    inner = F.from_json(F.try_element_at("m", F.lit("conversation")), _MAP)
    holder = F.when(F.array_contains(F.map_keys("m"), "conversation"), inner).otherwise(F.col("m"))
    fields = fields.select("sample", holder.alias("m")).select("sample", "m", F.explode_outer("m").alias("key", "value"))
    # the outer explode infers no filter that would parse the sample again
    fields = fields.where(F.col("key").rlike(_SESSION)).select(
        "sample",
        F.regexp_extract("key", _SESSION, 1).cast("int").alias("session"),
        "key",
        F.from_json("value", _TURNS).alias("turns"),
        F.coalesce(F.try_element_at("m", F.concat("key", F.lit("_date_time"))), F.lit("")).alias("timestamp"),
    )
    owner = sample_user("sample", user, user_prefix)
    return filter_numbers(fields, "session", session_range).select(
        "sample",
        "session",
        transcript_of(F.coalesce("turns", F.array().cast(_TURNS)), "timestamp").alias("text"),
        session_path(owner, "key", path_root).alias("path"),
        owner.alias("user_id"),
        "timestamp",
    )


def number_sessions(df: DataFrame, by: str = "sample", session: str = "session", out: str = "position") -> DataFrame:
    """1-based position of every session within its sample, by number and not by name.

    Numbers are counted per stretch of NUMBERS_PER_STRETCH first, so a sample with very many sessions is numbered by
    many tasks and only its stretches meet in one.
    """
    number = col(session).cast("bigint")
    rows = df.withColumn("_stretch", F.floor(number / NUMBERS_PER_STRETCH))
    before = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(by, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    stretches = stretches.select(by, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_stretch").orderBy(number)
    placed = rows.withColumn("_at", F.row_number().over(within)).join(stretches, [by, "_stretch"])
    return placed.withColumn(out, F.col("_before") + F.col("_at")).select(*df.columns, out)


def sort_sessions(df: DataFrame, by: str = "sample", session: str = "session") -> DataFrame:
    return df.orderBy(by, col(session).cast("bigint"))


def questions(
    samples: DataFrame,
    *,
    sample_range: str | None = None,
    user: str | None = None,
    user_prefix: str = "user_",
    missing_answer: str | None = None,
) -> DataFrame:
    """The questions of each sample: sample, position, question, ground_truth, evidence, category, user_id.

    A question without an answer has a null ground truth unless `missing_answer` says otherwise.
    """
    chosen = filter_numbers(samples, "sample", sample_range)
    fields = chosen.select("sample", F.from_json("content", "struct<qa:array<string>>").alias("s"))
    rows = fields.select("sample", F.posexplode("s.qa").alias("position", "item"))
    qa = F.from_json("item", _MAP)

    def value(name: str):
        return F.try_element_at(F.col("qa"), F.lit(name))

    evidence = F.coalesce(
        F.from_json(value("evidence"), "array<string>"),
        F.when(value("evidence").isNotNull(), F.array(value("evidence"))),
    )
    return rows.select("sample", "position", qa.alias("qa")).select(
        "sample",
        "position",
        value("question").alias("question"),
        F.coalesce(value("answer"), F.lit(missing_answer)).alias("ground_truth"),
        evidence.alias("evidence"),
        value("category").alias("category"),
        sample_user("sample", user, user_prefix).alias("user_id"),
    )


def question_lines(lines: DataFrame, user: str | None = None) -> DataFrame:
    """Questions from (line): JSON objects with question, ground_truth and user_id, or plain question text."""
    item = F.when(F.col("line").startswith("{"), F.from_json("line", _MAP))

    def value(name: str):
        return F.try_element_at(F.col("_item"), F.lit(name))

    kept = [c for c in lines.columns if c != "line"]
    return lines.withColumn("_item", item).select(
        *kept,
        F.coalesce(value("question"), F.when(F.col("_item").isNull(), F.col("line"))).alias("question"),
        value("ground_truth").alias("ground_truth"),
        F.coalesce(F.lit(user).cast("string"), value("user_id")).alias("user_id"),
    )


def text_lines(lines: DataFrame, user: str | None = None) -> DataFrame:
    """Texts to ingest from JSON lines (path, line) with text, path, user_id and timestamp; others are left out."""
    item = F.from_json(F.when(F.col("line").startswith("{"), F.col("line")), _MAP)

    def value(name: str):
        return F.try_element_at(F.col("_item"), F.lit(name))

    given = lines.select("path", item.alias("_item"))
    rows = given.select(
        value("text").alias("text"),
        F.coalesce(value("path"), F.col("path")).alias("path"),
        F.coalesce(F.lit(user).cast("string"), value("user_id")).alias("user_id"),
        value("timestamp").alias("timestamp"),
    )
    return clean_text(rows)
