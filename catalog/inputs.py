"""Stand-ins for the inputs of a memory pipeline, derived from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.functions.text import WHITESPACE

# Fixed point in time for rows without a timestamp.
NOW_MS = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------- SQL pieces


def sql_chars(text: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in text)


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {sql_chars(WHITESPACE)})"


def sql_choice(number: str, *values: str) -> str:
    """SQL CASE picking a value by number modulo their count."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {number} % {len(values)} {whens} END)"


def choice(number: Column, *values: Column | str) -> Column:
    """The Spark side of `sql_choice`."""
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
    picked = None
    for i, value in enumerate(columns):
        hit = number % len(columns) == i
        picked = F.when(hit, value) if picked is None else picked.when(hit, value)
    return picked


def sql_uuid(*parts: str) -> str:
    """Content identifier of the given text expressions."""
    joined = f"md5(concat_ws(chr(31), {', '.join(f'coalesce({p}, '')' for p in parts)}))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "||'-'||".join(f"substr({joined}, {start}, {length})" for start, length in cuts)


def sql_hash_vector(text: str, dimensions: int) -> str:
    """Unit vector of the hash embedder for a text expression."""
    word = f"md5(concat_ws(':', '', (i // 4)::VARCHAR, md5({text})))"
    part = f"('0x' || substr({word}, (i % 4) * 8 + 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1.0"
    raw = f"list_transform(range({dimensions}), lambda i: {part})"
    return f"""list_transform([{raw}], lambda v: list_transform(v, lambda x:
        (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE))[1]"""


def sql_l2_score(a: str, b: str) -> str:
    return f"1.0 - list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def sql_cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


# ---------------------------------------------------------------------------------------------- memories


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector, label, scope: label 0 is global, the others belong to a user each."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").alias("vector"),
        "label",
        F.when(F.col("label") == 0, "global").otherwise(F.concat(F.lit("user:"), "label")).alias("scope"),
    )


SQL_VECTORS = """
vectors AS (
  SELECT vec_id::VARCHAR AS id, vec_id, embedding::DOUBLE[] AS vector, label,
         CASE WHEN label = 0 THEN 'global' ELSE 'user:' || label END AS scope
  FROM embeddings)
"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored memories: the vectors with the text of the document of the same number, where there is one."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("doc"), F.col("lang")
    )
    number = F.col("id").cast("bigint")
    return (
        vectors(spark, sf_dir)
        .join(docs, "id", "left")
        .select(
            "id",
            F.coalesce("doc", F.concat(F.lit("memory "), "id")).alias("text"),
            "vector",
            choice(F.col("label"), "preference", "fact", "decision", "entity", "other").alias("category"),
            (F.col("label") / 10.0).alias("importance"),
            (F.lit(NOW_MS) + number * 1000).alias("timestamp"),
            "scope",
            F.to_json(F.struct("label", F.col("lang"))).alias("metadata"),
        )
    )


SQL_MEMORIES = (
    SQL_VECTORS
    + f""",
memories AS (
  SELECT v.id, coalesce(d.text, 'memory ' || v.id) AS text, v.vector,
         {sql_choice("v.label", "'preference'", "'fact'", "'decision'", "'entity'", "'other'")} AS category,
         v.label / 10.0::DOUBLE AS importance, {NOW_MS} + v.vec_id * 1000 AS timestamp, v.scope,
         v.label, d.lang
  FROM vectors v LEFT JOIN documents d ON d.doc_id = v.vec_id)
"""
)


# ---------------------------------------------------------------------------------------------- files


def doc_path(suffix: Column | str = ".md") -> Column:
    folder = choice(F.col("doc_id"), "preferences", "events", "entities", "notes")
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit("/in/"), folder, F.lit("/"), F.col("doc_id").cast("string"), suffix)


def sql_doc_path(suffix: str = "'.md'") -> str:
    folder = sql_choice("doc_id", "'preferences'", "'events'", "'entities'", "'notes'")
    return f"('/in/' || {folder} || '/' || doc_id || {suffix})"


def doc_files(spark: SparkSession, sf_dir: str, suffix: Column | str = ".md") -> DataFrame:
    """Documents as (path, text) files."""
    return table(spark, sf_dir, "documents").select("doc_id", doc_path(suffix).alias("path"), "text")


def one_line(text: Column | str) -> Column:
    return F.regexp_replace(text, "[\r\n]", " ")


SQL_ONE_LINE = "regexp_replace(text, '[\\r\\n]', ' ', 'g')"
