"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

DataFrame and ML-pipeline operations only. A paragraph is a line of a whole text. Its words and word pairs are hashed into
a sparse vector, and a multinomial logistic regression gives a probability for each licence family and for ordinary text.
It is trained here on the published notices (whole, without some words, and inside other words) against ordinary text: a
few fixed sentences and the lines of a bounded sample of documents (at most ``SAMPLE``: the first of each hash bucket of ids;
of their distinct lines at most ``SAMPLE_LINES``, by hash), without those that use a word of licences. Both bounds hold for
training only: every line of every document is scored. Probabilities are calibrated: a temperature is fitted on lines left out of training.

A line that is likelier of some licence family than ordinary gets that family if its calibrated probability is at least
``KNOWN`` and at least ``CONFIRMED`` of its word pairs, or of a notice's, are shared with one of the family's notices; else
it is "unknown": text of a licence kind that no template confirms. The templates are fixed and few, so they are joined as a
small table.

Defined results: null and empty texts have no paragraphs and an empty list; repeated rows give equal rows, and null ids
pass through.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.llm.licence_texts import FAMILIES, ORDINARY
from memoloom.workspace import materialized

NONE = "none"
LABELS = [NONE, *sorted(FAMILIES)]
FEATURES = 1 << 13
SAMPLE = 300
SAMPLE_LINES = 3000
KNOWN = 0.5
CONFIRMED = 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def pairs(w: Column) -> Column:
    """Neighbouring words, with marks at both ends."""
    return F.zip_with(F.concat(F.array(F.lit("<")), w), F.concat(w, F.array(F.lit(">"))), lambda a, b: F.concat_ws(" ", a, b))


def grams(w: Column) -> Column:
    return F.concat(w, pairs(w))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, line, w): the words of every line that has some."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    return lines.select("doc_id", "text_key", "line", words(F.col("t")).alias("w")).where(F.size("w") > 0)


def training_rows(spark: SparkSession, sample: DataFrame) -> DataFrame:
    """(label, fold, w) from the notices, changed in fixed ways, and from ordinary lines (text)."""
    rows = []
    for label, notices in FAMILIES.items():
        for notice in notices:
            parts = notice.split()
            changed = [parts, *([*parts[:k], *parts[k + 1 :]] for k in range(0, len(parts), max(1, len(parts) // 5)) if len(parts) > 5)]
            changed += [["the", "files", *parts], [*parts, "see", "below"], ["copyright", "2021", "a", "person", *parts]]
            rows += [(label, k, " ".join(c)) for k, c in enumerate(changed)]
    rows += [(NONE, k % 6, s) for k, s in enumerate(ORDINARY * 2)]
    fixed = spark.createDataFrame(rows, "label string, fold int, text string")
    naming = "licen[cs]e|copyright|warrant|redistribut|permi(t|ssion)|public domain|gnu |apache|creative commons|cc by|cc0|rights reserved|spdx|mozilla"
    ordinary = sample.where(~F.lower("text").rlike(naming)).select(F.lit(NONE).alias("label"), F.pmod(F.xxhash64("text"), F.lit(6)).cast("int").alias("fold"), "text")
    return fixed.union(ordinary).select("label", "fold", words(F.col("text")).alias("w"))


def ordinary_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines (text) of a bounded sample of documents."""
    rows = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE))
    first = rows.groupBy(place.alias("place")).agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("first"))
    chosen = rows.join(F.broadcast(first.select("first.doc_id")), "doc_id", "left_semi")  # at most SAMPLE ids
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("text"))
    return lines.where(F.length("text") > 0).distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE_LINES)


def _vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(rows.withColumn("grams", grams(F.col("w")))).drop("grams")


def train(spark: SparkSession, sample: DataFrame) -> tuple[PipelineModel, float]:
    """The classifier and its temperature."""
    number = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")) - 1
    rows = _vectors(materialized(training_rows(spark, sample).coalesce(1), "licence-lines")).select(number.cast("double").alias("y"), "fold", "features")
    regression = LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-3, maxIter=40, family="multinomial")
    held = regression.fit(rows.where("fold <> 1")).transform(rows.where("fold = 1"))
    margins = held.select("y", vector_to_array("rawPrediction").alias("m"))
    losses = [_loss(margins, t).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    found = margins.agg(*losses).first()
    temperature = min(zip(found, TEMPERATURES, strict=True), key=lambda x: math.inf if x[0] is None else x[0])[1]
    return regression.fit(rows), temperature


TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


def _softmax(margins: Column, temperature: float) -> Column:
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp((m - top) / temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda p: p / total)


def _loss(margins: DataFrame, temperature: float) -> Column:
    p = F.element_at(_softmax(F.col("m"), temperature), F.col("y").cast("int") + 1)
    return F.avg(-F.log(F.greatest(p, F.lit(1e-12))))


def templates(spark: SparkSession) -> DataFrame:
    """(family, notices): the word pairs of each notice of a family."""
    rows = spark.createDataFrame([(f, n) for f, notices in FAMILIES.items() for n in notices], "family string, text string")
    return rows.select("family", F.array_distinct(pairs(words(F.col("text")))).alias("p")).groupBy("family").agg(F.collect_list("p").alias("notices"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, line, family, probability) of every line of a licence kind; family "unknown" if not confirmed."""
    spark = docs.sparkSession
    model, temperature = train(spark, ordinary_sample(docs, id_col, text_col))
    scored = model.transform(_vectors(paragraphs(docs, id_col, text_col))).where(F.col("prediction") > 0)
    # written, as few lines pass and what follows looks at the margins many times
    lines = materialized(scored.select("doc_id", "text_key", "line", "w", vector_to_array("rawPrediction").alias("m")), "licence-suspects")
    likely = lines.withColumn("p", _softmax(F.col("m"), temperature))
    families = F.slice("p", 2, len(LABELS) - 1)
    best = F.element_at(F.array(*[F.lit(x) for x in LABELS[1:]]), F.array_position(families, F.array_max(families)).cast("int"))
    likely = likely.select("doc_id", "text_key", "line", F.array_max(families).alias("probability"), best.alias("family"), F.array_distinct(pairs(F.col("w"))).alias("own"))
    joined = likely.join(F.broadcast(templates(spark)), "family")  # a dozen fixed rows
    shared = lambda t: F.size(F.array_intersect("own", t)) / F.least(F.size("own"), F.size(t))
    confirmed = F.exists("notices", lambda t: shared(t) >= CONFIRMED)
    return joined.select("doc_id", "text_key", "line", F.when(confirmed & (F.col("probability") >= KNOWN), F.col("family")).otherwise("unknown").alias("family"), "probability")


def document_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, families (confirmed ones, comma-joined), n_lines (of a licence kind), n_unknown, probability (highest) of
    every document."""
    found = materialized(scan(docs, id_col, text_col).distinct(), "licence-lines-found")
    known = F.array_sort(F.collect_set(F.when(F.col("family") != "unknown", F.col("family"))))
    per = found.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        known.alias("families"),
        F.count("*").alias("n_lines"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.max("probability").alias("probability"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), zero("n_lines"), zero("n_unknown"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
