"""Near copies by exact Jaccard similarity of word shingles: SimHash groups and MinHash bands propose, full sets decide.

Texts with the same set of five-word shingles are one node. Two sources propose pairs of nodes: the Gray-order SimHash index
over five-word fingerprints (its groups within three bits, each node with the first one of its group), which takes in most
copies, and the bands of ``minhash``, which also reach the near copies that lie further apart: most pairs at similarity 0.8 differ
in five to ten bits. Every proposed pair is compared on its full sets, so fingerprints never join unlike texts, and a
pair at similarity 0.8 is missed by the bands with a chance of 5e-8. A shingle that very many unlike texts share proposes nothing.

Defined results: words as in ``simhash`` (split at ASCII white space, ASCII letters in lower case); a text of one to five words has one
shingle, all of it; null and wordless texts are equal to each other; every row gives a row, repeated rows included, and is judged
by its own text. A row with a null id takes its component from rows that have one, or null. Texts of any length are used whole; other columns
are not read, whatever they are called; an empty table gives no rows. Shingles are compared by their XXH64 values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoloom.llm import minhash, simhash
from memoloom.llm.storage import small_batches

WORDS = 5


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (smallest id reachable over near copies) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        groups = simhash.near_duplicates(rows, shingle=WORDS).where("doc_id <> component_id")
        proposed = groups.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
        return minhash.classes(rows, WORDS, empty_alike=True, proposed=proposed).select("doc_id", "component_id")
