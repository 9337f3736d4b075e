"""Benchmark decontamination by a distributed positional inverted index; DataFrame operations only.

Training texts are cut into words once and written. Every window of test words is looked up by its rarest words: word
counts over the whole corpus say which they are, and only their postings (word, document, position) go into the stored
index. A posting of the rarest word gives a place where the window may start; the postings of the next rarest words,
moved by their offsets, must give the same place. What is left of these intersections is compared word by word.

A frequent word costs nothing unless a window has no rarer one. Joins are on keys, so very long posting lists are split by
adaptive skew joins; small tables are written first, so that Spark decides by their true size whether to broadcast them.

Defined results: a null text has no words; an item without words has no window; a window or document that stands there
several times gives the same answer each time; rows with a null id are judged too; items with a null id match but are
named nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memoloom.llm.storage import written

WINDOW = 10
#: Words of a window whose posting lists are intersected.
LISTS = 3
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: what separates words, all of ASCII but digits and small letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower())
    return F.array_remove(F.split(lower, _BETWEEN), "")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, words), written; the key tells texts apart that share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words(text).alias("words"))
    return written(cut.select("doc_id", "text_key", F.size("words").alias("n_words"), "words"), "leaks-words")


def test_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase): every run of so many words of an item, or all its words if it has fewer; written."""
    cut = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    phrases = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("phrase"))
    return written(phrases.distinct(), "leaks-windows")


def _postings(cut: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, text_key, pos) of the given terms (column term)."""
    rows = cut.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term"))
    return rows.join(terms, "term", "left_semi")


def rarest_words(cut: DataFrame, windows: DataFrame, lists: int = LISTS) -> DataFrame:
    """(phrase, n, picks): the window's rarest words over the corpus as (count, shift, term), rarest first; written."""
    phrases = windows.select("phrase").distinct()
    placed = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("shift", "term"))
    terms = written(placed.select("term").distinct(), "leaks-terms")
    counted = cut.select(F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term").count()
    ranked = placed.join(written(counted, "leaks-counts"), "term", "left")
    pick = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shift", "term")
    # a window has few words, so they may be gathered
    gathered = ranked.groupBy("phrase").agg(F.sort_array(F.collect_list(pick)).alias("picks"))
    picked = gathered.select("phrase", F.size("picks").alias("n"), F.slice("picks", 1, lists).alias("picks"))
    return written(picked, "leaks-rarest")


def build_index(cut: DataFrame, picked: DataFrame) -> DataFrame:
    """The stored postings of all picked words, ordered by word inside each file."""
    terms = written(picked.select(F.explode("picks.term").alias("term")).distinct(), "leaks-picked")
    return written(_postings(cut, terms).sortWithinPartitions("term", "doc_id", "pos"), "leaks-index")


_PLACE = ["doc_id", "text_key", "phrase", "n", "start"]


def _first_list(index: DataFrame, picked: DataFrame) -> DataFrame:
    """Places where a window may start by its rarest word, with the other picks."""
    first = picked.select("phrase", "n", "picks", F.col("picks")[0]["term"].alias("term"), F.col("picks")[0]["shift"].alias("shift"))
    placed = index.join(first, "term").withColumn("start", F.col("pos") - F.col("shift")).where("start >= 0")
    return placed.select(*_PLACE, F.slice("picks", 2, LISTS).alias("others")).distinct()


def intersected(index: DataFrame, picked: DataFrame) -> DataFrame:
    """Places (doc_id, text_key, phrase, n, start) on which the offset-adjusted lists of all picks agree."""
    placed = _first_list(index, picked)
    alone = placed.where(F.size("others") == 0).select(*_PLACE)
    asked = placed.select(*_PLACE, F.size("others").alias("asked"), F.explode("others").alias("other"))
    asked = asked.select(*_PLACE, "asked", F.col("other.term").alias("term"), (F.col("start") + F.col("other.shift")).alias("pos"))
    known = index.distinct()
    same = [asked[c].eqNullSafe(known[c]) for c in ("doc_id", "text_key", "term", "pos")]
    met = asked.join(known, same, "left_semi").groupBy(*_PLACE, "asked").count().where("count = asked")
    return alone.union(met.select(*_PLACE))


def phrase_matches(cut: DataFrame, places: DataFrame) -> DataFrame:
    """The places at which every word of the window stands, compared in the written words."""
    places = written(places, "leaks-places")
    texts = cut.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "words")
    once = texts.join(
        written(places.select("doc_id", "text_key").distinct(), "leaks-suspects"),
        F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")),
        "left_semi",
    )
    joined = once.join(places, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")))
    exact = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("phrase")
    return joined.where(exact).select(*_PLACE).distinct()


def proximity_matches(index: DataFrame, picked: DataFrame, slop: int = 5) -> DataFrame:
    """(doc_id, text_key, phrase, n, start): the rarest word's place, where each other picked word stands within ``slop``
    positions of where the window would have it."""
    placed = _first_list(index, picked)
    width = slop + 1
    near = placed.select(*_PLACE, F.size("others").alias("asked"), F.posexplode("others").alias("which", "other"))
    near = near.withColumn("want", F.col("start") + F.col("other.shift")).withColumn("term", F.col("other.term"))
    cell = F.floor(F.col("want") / width)
    near = near.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    known = index.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("term").alias("t"), "pos", F.floor(F.col("pos") / width).alias("c"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("term") == F.col("t")) & (F.col("cell") == F.col("c"))
    hits = near.join(known, same).where(F.abs(F.col("pos") - F.col("want")) <= slop)
    met = hits.select(*_PLACE, "asked", "which").distinct().groupBy(*_PLACE, "asked").count().where("count = asked")
    return placed.where(F.size("others") == 0).select(*_PLACE).union(met.select(*_PLACE))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    cut = cut_documents(docs)
    windows = test_windows(items, window)
    picked = rarest_words(cut, windows)
    found = written(phrase_matches(cut, intersected(build_index(cut, picked), picked)), "leaks-found")
    key = ["doc_id", "text_key"]
    spans = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = spans.withColumn("hit", F.greatest(F.lit(0), F.col("end") - reached)).groupBy(*key).agg(F.sum("hit").alias("n_hit"))
    named = found.select(*key, "phrase").join(windows, "phrase").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    items_of = named.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))  # at most one entry an item
    out = cut.select(*key, "n_words")
    for side in (hits, items_of):
        side = side.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
