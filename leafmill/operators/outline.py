"""Headings of a document against its outline: pages by title, and suffix-tolerant matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.nodes import link

MIN_SUFFIX = 5


def heading_pages(items: DataFrame) -> DataFrame:
    """items: doc_id, ord, is_heading, text, page. The pages of headings by title, in order, counted
    per title: doc_id, key, k, page."""
    own = items.filter(F.col("is_heading") & F.col("page").isNotNull()).withColumn("key", T.title_key(F.col("text"))).filter("key <> ''")
    k = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("ord"))
    return own.select("doc_id", "key", k.alias("k"), "page")


def match_outline(toc: DataFrame, items: DataFrame) -> DataFrame:
    """toc: doc_id, i, level, title, page. items: doc_id, ord, text, page. For each entry the item on
    its page whose title is the same, or ends with it (or the other way round) if long enough; the
    same wins, then the shortest, then the first. Parents come from the levels. doc_id, i, ord, parent."""
    entries = toc.withColumn("t", T.title_key(F.col("title")))
    own = items.select("doc_id", "ord", "page", T.title_key(F.col("text")).alias("k"))
    close = F.col("k").endswith(F.col("t")) | F.col("t").endswith(F.col("k"))
    both = entries.join(own, ["doc_id", "page"]).filter((F.col("k") == F.col("t")) | (close & (F.least(F.length("k"), F.length("t")) >= MIN_SUFFIX)))
    best = both.groupBy("doc_id", "i").agg(F.min_by("ord", F.struct((F.col("k") != F.col("t")).cast("int"), F.length("k"), "ord")).alias("ord"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    tree = link(toc.select("doc_id", "i", T.clamp_level(F.col("level")).alias("level"), place.alias("ord"))).select("doc_id", "i", F.col("parent_ord").alias("parent"))
    return tree.join(best, ["doc_id", "i"], "left").select("doc_id", "i", "ord", "parent")


def read_outline(entries: DataFrame) -> DataFrame:
    """entries as a file holds them: doc_id, i, level and page from 0, title; a page that can't be resolved
    is null. The outline in its order, counted from 1, unresolved pages as 0; documents with fewer
    than two entries have none."""
    whole = Window.partitionBy("doc_id")
    page = F.coalesce(F.col("page") + 1, F.lit(0))
    return entries.select("doc_id", "i", (F.col("level") + 1).alias("level"), "title", page.alias("page"), F.count("*").over(whole).alias("n")).filter("n >= 2").drop("n")
