"""Sources and sinks: the tables are written out as files of the reference kinds first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import query
from catalog.inputs import (
    SQL_MEMORIES,
    SQL_ONE_LINE,
    memories,
    one_line,
    sql_strip,
    table,
    vectors,
)
from memoloom.functions.text import strip
from memoloom.schemas import JUDGE_RESULT
from memoloom.sources import files, json_array, listing, memory_table
from memoloom.workspace import fresh_path

DOCS_PER_FILE = 200


def _write_lines(df, path: str) -> None:
    """Write one text column as files of a bounded number of lines."""
    df.write.option("maxRecordsPerFile", DOCS_PER_FILE).text(path)


@query(
    "src_files",
    f"""
    SELECT lang AS folder, sum(octet_length(encode({SQL_ONE_LINE})) + 1)::BIGINT AS bytes, 2::BIGINT AS empty
    FROM documents GROUP BY lang
    """,
)
def src_files(spark, sf_dir):
    root = fresh_path(spark, "files")
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(one_line("text").alias("value"), F.col("lang").alias("folder"))
    lines.write.partitionBy("folder").text(f"{root}/kept")
    docs.write.json(f"{root}/other")  # suffix .json: not listed
    # in every folder an empty file, and one that is hidden and empty
    names = docs.select("lang").distinct().select(F.explode(F.array(*[F.concat(F.lit("folder="), "lang", F.lit(n)) for n in ("/none.txt", "/_none.MD")])))
    listing.touch(names, f"{root}/kept")
    found = files.list_files(spark, [root, f"{root}/missing"])
    folder = F.regexp_extract("path", "folder=([^/]*)/", 1)
    sums = [F.sum("length").alias("bytes"), F.sum((F.col("length") == 0).cast("bigint")).alias("empty")]
    return found.groupBy(folder.alias("folder")).agg(*sums)


@query(
    "src_read_text",
    f"SELECT doc_id, {sql_strip(SQL_ONE_LINE)} AS text FROM documents",
)
def src_read_text(spark, sf_dir):
    root = fresh_path(spark, "texts")
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), one_line("text"), F.lit("\r"))
    _write_lines(table(spark, sf_dir, "documents").select(line), root)
    whole = files.read_texts(spark, [root])
    lines = whole.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(
        F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"),
        strip(F.regexp_replace("line", "^[0-9]+\t", "")).alias("text"),
    )


RESULT = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("context_ids", T.ArrayType(T.StringType())),
        T.StructField("judge_result", JUDGE_RESULT),
    ]
)


@query(
    "io_json_array",
    """
    SELECT text AS question, CASE WHEN doc_id % 3 <> 0 THEN lang END AS answer, doc_id || ',' || source AS context_ids,
           source AS reasoning, ((doc_id % 4) / 4.0)::DOUBLE AS score, 'again' AS label
    FROM documents
    """,
)
def io_json_array(spark, sf_dir):
    root = fresh_path(spark, "results")
    n = F.col("doc_id")
    item = F.struct(
        F.col("text").alias("question"),
        F.when(n % 3 != 0, F.col("lang")).alias("answer"),
        F.array(n.cast("string"), F.col("source")).alias("context_ids"),
        F.struct(F.col("source").alias("reasoning"), ((n % 4) / 4.0).alias("score")).alias("judge_result"),
    )
    json_array.write_json_arrays(table(spark, sf_dir, "documents").select(item.alias("item")).select("item.*"), f"{root}/arrays")
    rows = json_array.read_json_array(spark, [f"{root}/arrays"], RESULT)
    json_array.write_results(rows, f"{root}/out")
    stored = json_array.read_results(spark, f"{root}/out", RESULT)
    labelled = F.col("judge_result").withField("label", F.lit("again"))
    json_array.replace_results(stored.withColumn("judge_result", labelled), f"{root}/out")
    back = json_array.read_results(spark, f"{root}/out", RESULT)
    return back.select("question", "answer", F.array_join("context_ids", ",").alias("context_ids"), "judge_result.*")


# ---------------------------------------------------------------------------------------------- memory table


def _entries(spark, sf_dir):
    return memories(spark, sf_dir).withColumn("createdAt", F.col("timestamp"))


DIMENSION = 64


@query(
    "tbl_create",
    f"""
    SELECT mode, {DIMENSION}::BIGINT AS dimension, columns, count(*) AS rows
    FROM embeddings,
         (VALUES ('basic', 'id,text,vector,category,importance,createdAt'),
                 ('pro', 'id,text,vector,category,importance,timestamp,scope,metadata')) m(mode, columns)
    GROUP BY mode, columns
    """,
)
def tbl_create(spark, sf_dir):
    states = []
    for mode in ("basic", "pro"):
        path = fresh_path(spark, f"memories-{mode}")
        memory_table.create_table(spark, path, DIMENSION, mode)
        memory_table.append(_entries(spark, sf_dir), path)
        again = memory_table.create_table(spark, path, DIMENSION, mode)  # opens what is there
        states.append(
            again.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(memory_table.table_mode(again)).alias("mode"),
                F.lit(memory_table.table_dimension(again)).cast("bigint").alias("dimension"),
                F.lit(",".join(again.columns)).alias("columns"),
                "rows",
            )
        )
    return states[0].unionByName(states[1])


@query(
    "tbl_append",
    f"""
    WITH {SQL_MEMORIES}
    SELECT id, text, len(vector) AS dimension, round(vector[64], 6) AS last_component, category, importance,
           timestamp, scope, label::VARCHAR AS label, times, (SELECT count(*) FROM memories) AS inserted
    FROM memories, (VALUES (1), (2)) t(times)
    """,
)
def tbl_append(spark, sf_dir):
    path = fresh_path(spark, "memories")
    memory_table.create_table(spark, path, DIMENSION)
    inserted = memory_table.append(_entries(spark, sf_dir), path)
    again = memory_table.append(_entries(spark, sf_dir).withColumn("metadata", F.lit('{"times": 2}')), path)
    if inserted != again:
        raise AssertionError(f"appended {inserted} and {again} rows of the same frame")
    rows = spark.read.parquet(path)
    labels = vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("label"))
    return rows.join(labels, "id").select(
        "id",
        "text",
        F.size("vector").cast("bigint").alias("dimension"),
        F.round(F.element_at("vector", 64).cast("double"), 6).alias("last_component"),
        "category",
        "importance",
        "timestamp",
        "scope",
        "label",
        F.coalesce(F.get_json_object("metadata", "$.times").cast("int"), F.lit(1)).alias("times"),
        F.lit(inserted).cast("bigint").alias("inserted"),
    )


@query(
    "tbl_inspect",
    f"""
    WITH {SQL_MEMORIES}
    SELECT count(*) AS rows, min(len(vector)) AS min_dimension, max(len(vector)) AS max_dimension, min(id) AS sample_id,
           min_by(text, id) AS sample_text, min_by(scope, id) AS sample_scope, min_by(timestamp, id) AS sample_time
    FROM memories
    """,
)
def tbl_inspect(spark, sf_dir):
    looked = memory_table.inspect(memories(spark, sf_dir))
    return looked.select(
        "rows",
        F.col("min_dimension").cast("bigint").alias("min_dimension"),
        F.col("max_dimension").cast("bigint").alias("max_dimension"),
        F.col("sample.id").alias("sample_id"),
        F.col("sample.text").alias("sample_text"),
        F.col("sample.scope").alias("sample_scope"),
        F.col("sample.timestamp").alias("sample_time"),
    )
