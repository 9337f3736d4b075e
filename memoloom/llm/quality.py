"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

The statistics are computed once per text inside tasks (Arrow batches). Class moments are sums over all labelled rows,
pre-aggregated by Spark before the shuffle; the driver sees one row of sums per class and factors two small matrices.
Scores are column expressions: Mahalanobis distances through the cached Cholesky factors.

Defined results: a null text counts as empty; an empty text has a score; rows with a null id pass through and are never
learned from; a null label is no label; repeated label rows count as often as they stand there. With one class only every
score is that class, with no labels at all every score is 0.5. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.llm.storage import cut_small
from memoloom.workspace import materialized

STATISTICS = (
    "words",
    "word_length",
    "upper",
    "symbols",
    "stops",
    "distinct_words",
    "top_word",
    "adjacent_repeats",
    "bare_symbols",
    "distinct_lines",
    "digits",
    "long_words",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC3:] = True  # lead bytes of letters beyond ASCII
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _STOP)
_WIDE_UPPER = re.compile("[À-ÖØ-Þ]")


#: Every ratio starts from so many words of ordinary text, so that a short text is judged by little evidence, mildly.
PRIOR_WORDS = 25
PRIOR_LINES = 4


def _ratio(count: float, n: float, usual: float, prior: float = PRIOR_WORDS) -> float:
    return (count + usual * prior) / (n + prior)


def text_statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; square roots and logarithms keep heavy tails near a normal shape."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    words = text.split()
    n = len(words)
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = [line for line in text.split("\n") if line]
    upper = int(counts[_UPPER].sum()) + len(_WIDE_UPPER.findall(text))
    bare = sum(c for w, c in tally.items() if len(w) <= 3 and not any(map(str.isalnum, w)))
    long_words = sum(c for w, c in tally.items() if len(w) >= 8)
    return [
        math.log(n + PRIOR_WORDS),
        math.log(_ratio(len(text), n, 6.0)),
        math.sqrt(_ratio(upper, int(counts[_LETTER].sum()), 0.03, 5 * PRIOR_WORDS)),
        math.sqrt(_ratio(int(counts[_SYMBOL].sum()), len(text), 0.0, 6 * PRIOR_WORDS)),
        math.sqrt(_ratio(int(counts[_STOP].sum()), n, 0.15)),
        math.sqrt(_ratio(len(tally), n, 0.9) * math.log(n + PRIOR_WORDS)),
        math.sqrt(_ratio(max(tally.values(), default=0), n, 0.05)),
        math.sqrt(_ratio(sum(map(str.__eq__, words, words[1:])), n, 0.0)),
        math.sqrt(_ratio(bare, n, 0.0)),
        _ratio(len(set(lines)), len(lines), 1.0, PRIOR_LINES),
        math.sqrt(_ratio(int(counts[_DIGIT].sum()), len(text), 0.0, 6 * PRIOR_WORDS)),
        math.sqrt(_ratio(long_words, n, 0.25)),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in cut_small(batches):
            values = [text_statistics(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, kind)], ["doc_id", "statistics"])

    return rows.mapInArrow(measure, "doc_id long, statistics array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: weight of its share, mean, and the inverse of the Cholesky factor of its shrunken covariance."""

    shares: dict[int, float]
    means: dict[int, np.ndarray]
    factors: dict[int, np.ndarray]
    log_dets: dict[int, float]

    def log_density(self, values: Column, label: int) -> Column:
        """Log of share times density, without the constant that both classes share."""
        mean, factor = self.means[label], self.factors[label]
        x = [F.element_at(values, i + 1) - F.lit(float(m)) for i, m in enumerate(mean)]
        distance = F.lit(0.0)
        for i in range(len(mean)):
            z = sum((x[j] * F.lit(float(factor[i, j])) for j in range(1, i + 1)), x[0] * F.lit(float(factor[i, 0])))
            distance = distance + z * z
        return F.lit(math.log(self.shares[label]) - 0.5 * self.log_dets[label]) - distance * 0.5

    def score(self, values: Column) -> Column:
        """Probability of class 1."""
        if not self.shares:
            return F.lit(0.5)
        if len(self.shares) == 1:
            return F.lit(float(next(iter(self.shares))))
        margin = self.log_density(values, 0) - self.log_density(values, 1)
        return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), margin))))


def fit(rows: DataFrame, shrinkage: float = 0.1, ridge: float = 1e-4) -> Discriminant:
    """Fit on (statistics, label) rows, all of them; the driver gets the sums of each class only."""
    d = len(STATISTICS)
    x = [F.element_at("statistics", i + 1) for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    classes = rows.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"), *sums, *products)
    found = {int(r["label"]): r for r in classes.collect()}  # at most two rows
    total = sum(r["n"] for r in found.values())
    means, spreads = {}, {}
    for label, r in found.items():
        means[label] = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"]
        spreads[label] = second - np.outer(means[label], means[label])
    shares, factors, log_dets = {}, {}, {}
    if found:
        pooled = sum(spreads[k] * found[k]["n"] for k in found) / total
    for label in found:
        target = np.diag(np.diag(0.5 * spreads[label] + 0.5 * pooled))
        covariance = (1 - shrinkage) * spreads[label] + shrinkage * target + ridge * np.eye(d)
        lower = np.linalg.cholesky(covariance)
        shares[label] = found[label]["n"] / total
        factors[label] = np.linalg.inv(lower)
        log_dets[label] = 2.0 * float(np.log(np.diag(lower)).sum())
    return Discriminant(shares, means, factors, log_dets)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", shrinkage: float = 0.1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labelled rows outside the held-out fold."""
    measured = materialized(with_statistics(docs), "quality-statistics")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    learned = measured.where(~held_out).join(known.where(~held_out), "doc_id")
    model = fit(learned, shrinkage)
    scored = measured.select("doc_id", held_out.alias("held_out"), model.score(F.col("statistics")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
