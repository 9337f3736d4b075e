"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles: a node is a path of tags and classes. How much the children of a
node differ over the pages (presentation), and how much the text in it does (content), is the entropy of what was seen
there, relative to all being different. What hardly varies over a site is its furniture. Branches whose importance is low
are left out of each page, and so are texts that stand at one place of the pages, if they are on at least ``FURNITURE`` of the
host's distinct pages, whatever their number; equal pages of a host count once. Elements that say
themselves that they are menus, adverts, comments and the like have no importance. If a page marks its article, only
that is main text.

Counts are summed per task and then per (host, node, feature) by Spark, so a host that holds a third of all pages is no
hot group. What comes back to the pages is one row per host with its low nodes, written first, so that Spark joins it by
its true size.

Defined results: null or empty html gives an empty text; a null url belongs to a nameless host; every row gives a row,
repeated rows and null ids included; a page whose branches are all unimportant keeps what no element marks as furniture.
Null, very long or broken html is parsed as far as it goes; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.llm.dom import Page
from memoloom.llm.storage import cut_small
from memoloom.workspace import materialized

#: Importance below which a branch goes, share of it that content decides, and pages of a host that it takes to judge.
THRESHOLD = 0.3
CONTENT_SHARE = 0.75
LEAST_PAGES = 4
#: Share of a host's distinct pages that must have a branch or text before it can be furniture.
FURNITURE = 0.7

_PAGES, _STYLE, _TEXT = 0, 1, 2


def host(url: Column) -> Column:
    """Name of the host in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_BLOCKS = "array<struct<text:string, feature:bigint, main:boolean, kept:boolean, nodes:array<bigint>, first:boolean>>"
_STYLES = "array<struct<node:bigint, feature:bigint>>"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, blocks, styles, part, rank_in_part) of every page; only the marked article's blocks where there are
    any. A block is first if no block before it has its text at its node. The last two name the row once the frame is written."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    block_kind = pa.list_(
        pa.struct([("text", pa.string()), ("feature", pa.int64()), ("main", pa.bool_()), ("kept", pa.bool_()), ("nodes", pa.list_(pa.int64())), ("first", pa.bool_())])
    )
    style_kind = pa.list_(pa.struct([("node", pa.int64()), ("feature", pa.int64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank = TaskContext.get().partitionId(), 0
        for batch in cut_small(batches):
            blocks, styles = [], []
            for html in batch.column(3).to_pylist():
                page = Page(html or "")
                own = [b for b in page.blocks if b.main] or page.blocks
                seen: set[tuple] = set()
                blocks.append([b.__dict__ | {"first": (at := (b.nodes[-1:], b.feature)) not in seen and not seen.add(at)} for b in own])
                styles.append([{"node": node, "feature": children} for node, children in page.styles])
            ranks = np.arange(rank, rank + batch.num_rows)
            rank += batch.num_rows
            columns = [*batch.columns[:3], pa.array(blocks, block_kind), pa.array(styles, style_kind), pa.array(np.full(len(ranks), part)), pa.array(ranks)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "blocks", "styles", "part", "rank_in_part"])

    return rows.mapInArrow(parse, f"page_id long, url string, host string, blocks {_BLOCKS}, styles {_STYLES}, part long, rank_in_part long")


def distinct_pages(rows: DataFrame) -> DataFrame:
    """Written parsed pages without those that have the blocks and styles of another page of their host."""
    place = F.struct("part", "rank_in_part")
    keyed = rows.select("host", F.xxhash64("blocks", "styles").alias("k1"), F.xxhash64(F.lit(1), "styles", "blocks").alias("k2"), place.alias("place"))
    firsts = keyed.groupBy("host", "k1", "k2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = keyed.join(firsts, ["host", "k1", "k2"]).where("place <> first").select("place.*")
    # written, so that the few copies there mostly are can be joined by their true size
    return rows.join(materialized(copies, "pages-copies"), ["part", "rank_in_part"], "left_anti")


def site_style_tree(rows: DataFrame) -> DataFrame:
    """(host, node, kind, feature, n, pages) summed over parsed pages: the merged trees of all hosts. n counts what was seen,
    pages the pages with a text at the node."""
    nodes = rows.select("host", F.explode(F.array_distinct("styles.node")).alias("node"), F.lit(_PAGES).alias("kind"), F.lit(0).cast("long").alias("feature"), F.lit(True).alias("first"))
    styles = rows.select("host", F.explode("styles").alias("s")).select("host", "s.node", F.lit(_STYLE).alias("kind"), "s.feature", F.lit(True).alias("first"))
    texts = rows.select("host", F.explode("blocks").alias("b")).select("host", F.element_at("b.nodes", -1).alias("node"), F.lit(_TEXT).alias("kind"), "b.feature", "b.first")
    return nodes.union(styles).union(texts).groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"), F.count_if("first").alias("pages"))


def _importance(kind: int):
    """Entropy of a node's features over the most it could be; 1 for what was seen once."""
    mine = F.when(F.col("kind") == kind, F.col("n"))
    total = F.sum(mine)
    entropy = F.log(total) - F.sum(mine * F.log(mine)) / total
    return F.when(total > 1, entropy / F.log(total)).otherwise(F.lit(1.0))


def low_nodes(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, nodes, features): nodes of low composite importance, and texts at one node, that most pages of a host (host,
    host_pages) have."""
    judged = tree.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == _PAGES, F.col("n"))).alias("pages"),
        _importance(_STYLE).alias("presentation"),
        _importance(_TEXT).alias("content"),
        F.sum(F.when(F.col("kind") == _TEXT, F.col("n"))).alias("texts"),
    )
    judged = judged.where(F.col("pages") >= LEAST_PAGES).join(sizes, "host").where(F.col("pages") >= FURNITURE * F.col("host_pages"))
    composite = F.col("content") * CONTENT_SHARE + F.col("presentation") * (1 - CONTENT_SHARE)
    nodes = judged.where((F.col("texts") > 0) & (composite < THRESHOLD)).select("host", "node", F.lit(None).cast("long").alias("feature"))
    frequent = tree.where((F.col("kind") == _TEXT) & (F.col("pages") >= LEAST_PAGES)).join(sizes, "host")
    frequent = frequent.where(F.col("pages") >= FURNITURE * F.col("host_pages"))
    both = nodes.union(frequent.select("host", F.lit(None).cast("long").alias("node"), "feature"))
    return both.groupBy("host").agg(F.collect_set("node").alias("nodes"), F.collect_set("feature").alias("features"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = materialized(parsed(pages, id_col, url_col, html_col), "pages-parsed")
    own = distinct_pages(rows)
    sizes = materialized(own.groupBy("host").agg(F.count("*").alias("host_pages")), "pages-sizes")
    low = materialized(low_nodes(materialized(site_style_tree(own), "pages-tree"), sizes), "pages-low").withColumnRenamed("host", "low_host")
    known = rows.join(low, F.col("host") == F.col("low_host"), "left")
    none = F.array().cast("array<bigint>")
    nodes, features = F.coalesce("nodes", none), F.coalesce("features", none)

    def important(b: Column) -> Column:
        branch = ~F.arrays_overlap(b["nodes"], nodes)
        return F.when(b["main"], b["kept"] | branch).otherwise(branch & ~F.array_contains(features, b["feature"]))

    left = F.filter("blocks", important)
    texts = F.transform(F.when(F.size(left) > 0, left).otherwise(F.col("blocks")), lambda b: b["text"])
    out = known.select("page_id", "url", F.array_join(texts, "\n").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
