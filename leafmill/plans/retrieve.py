"""The read operators over stored documents, and relevance search with pluggable models."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

# -- node filters ---------------------------------------------------------------------------------


def keyword_hits(nodes: DataFrame, query: str | Column) -> DataFrame:
    """Nodes with the query in title, summary or text, without regard to case; in order."""
    q = F.lower(F.lit(query)) if isinstance(query, str) else F.lower(query)
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(q)
    fields = [has(c) for c in ("title", "summary", "text") if c in nodes.columns]
    return nodes.filter(T.any_of(*fields))


def page_ranges(selector: str | Column) -> Column:
    """'3,5-7' as ranges (low, high); a reversed range is none; anything else raises."""
    parts = F.split(F.lit(selector) if isinstance(selector, str) else selector, ",")
    ends = lambda p: F.split(T.strip(p), "-")
    low = lambda p: T.strip(F.get(ends(p), F.lit(0))).cast("int")
    high = lambda p: T.strip(F.coalesce(F.get(ends(p), F.lit(1)), F.get(ends(p), F.lit(0)))).cast("int")
    return F.filter(F.transform(parts, lambda p: F.struct(low(p).alias("low"), high(p).alias("high"))), lambda r: r["low"] <= r["high"])


def page_set(selector: str | Column) -> Column:
    """'3,5-7' as an array of pages, for selectors that are known to be short."""
    return F.array_distinct(F.flatten(F.transform(page_ranges(selector), lambda r: F.sequence(r["low"], r["high"]))))


def on_pages(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes with text on a page of the selector; a node without pages is on page 0. Ranges are compared
    by their bounds, however long they are."""
    first, last = F.coalesce("start_index", F.lit(0)), F.coalesce("end_index", F.lit(0))
    hit = F.exists(page_ranges(selector), lambda r: (r["low"] <= last) & (first <= r["high"]) & (first <= last))
    return nodes.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).filter(hit)


# -- listing and reading -----------------------------------------------------------------------------


def recent_documents(listing: DataFrame, nodes: DataFrame, page: int = 1, size: int = 10, order: str = "newest") -> DataFrame:
    """A page of the listing with total and node counts (distinct ids; none for flat documents). Order:
    newest first, or by key. Page 0 is empty."""
    by = [F.desc("processed_at"), F.col("key")] if order == "newest" else [F.col("key")]
    total = listing.agg(F.count("*").alias("total"))
    # The page is cut first, and only nodes of its `size` documents are counted.
    cut = listing.orderBy(*by).offset(max(0, (page - 1) * size)).limit(size if page >= 1 else 0)
    own = nodes.join(F.broadcast(cut.select("doc_id")), "doc_id", "left_semi")
    counts = own.groupBy("doc_id").agg(F.count_distinct("node_id").alias("node_count"))
    return (
        cut.join(counts, "doc_id", "left")
        .crossJoin(F.broadcast(total))
        .select("total", F.lit(page).alias("page"), F.lit(size).alias("page_size"), "doc_id", "doc_name", F.lit("completed").alias("status"), F.coalesce("node_count", F.lit(0)).alias("node_count"))
    )


def get_document(nodes: DataFrame) -> DataFrame:
    """Per document: total_nodes and the top sections in order (title, node_id, pages)."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    pages = F.concat(number("start_index"), F.lit("-"), number("end_index"))
    top = F.collect_list(F.when(F.col("parent_ord").isNull(), F.struct("ord", "title", "node_id", pages.alias("pages"))))
    return nodes.groupBy("doc_id").agg(F.count_distinct("node_id").alias("total_nodes"), F.sort_array(top).alias("top_level_sections"))


def get_flat_document(flats: DataFrame) -> DataFrame:
    """flats: doc_id, blocks. A flat document has blocks instead of sections: their number, their roles in order, its class."""
    from leafmill.operators.flat import content_class

    return flats.select("doc_id", F.size("blocks").alias("total_blocks"), F.transform("blocks", lambda b: b["role"]).alias("roles"), content_class(F.col("blocks")).alias("content_class"))


def get_page_content(nodes: DataFrame, doc_id: object, pages: str) -> DataFrame:
    hits = on_pages(nodes.filter(F.col("doc_id") == F.lit(doc_id)), pages)
    return hits.orderBy("ord").select("node_id", "title", "start_index", "end_index", "text")


# -- relevance --------------------------------------------------------------------------------------

#: A model: from a prompt to an answer that holds a JSON list of ids. It may fail.
Model = Callable[[str], str]


def lexical_score(text: Column, query: str) -> Column:
    """Words of the query that occur; the default in place of a model, the same at every run."""
    words = sorted(set(query.lower().split()))
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def pick_in_order(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """picks: doc_id, pos. Picked documents that exist, once each, in the order of the picks; all
    documents, in their own order, if none of the picks exists."""
    first = picks.groupBy("doc_id").agg(F.min("pos").alias("pos"))
    found = docs.join(first, "doc_id")
    none = found.agg((F.count("*") == 0).alias("none"))
    every = docs.crossJoin(F.broadcast(none)).filter("none").drop("none").withColumn("pos", F.lit(None).cast("int"))
    return found.unionByName(every)


def texts_of_picks(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """picks: doc_id, pos, node_id. The texts of picked nodes by document, in the order of the picks,
    repeats kept, joined by a blank line."""
    hit = picks.join(nodes.filter("text IS NOT NULL AND text <> ''").select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return hit.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("content"))


def invented(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks that name no node."""
    return picks.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def assemble(parts: DataFrame) -> DataFrame:
    """parts: pos, doc_name, content. One row: all parts under their names, and the characters of the contents."""
    part = F.concat(F.lit("=== "), F.col("doc_name"), F.lit(" ===\n"), F.col("content"))
    full = parts.filter("content IS NOT NULL AND content <> ''")
    return full.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("content"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"),
        F.count("*").alias("sources"),
    )


def model_picks(prompts: DataFrame, client: Model) -> DataFrame:
    """prompts: key, prompt. The ids of each answer in its order: key, pos, picked; error rows have a
    null pos. An answer that can't be read, or a failing call, is a row of its own, never a failing job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for key, prompt in zip(b["key"], b["prompt"], strict=True):
                try:
                    said = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", client(prompt).strip())
                    ids = json.loads(said)
                    ids = ids.get("ids", []) if isinstance(ids, dict) else ids
                    rows += [(key, k, str(x), None) for k, x in enumerate(ids)] or [(key, None, None, "no ids")]
                except Exception as e:  # one document's answer is not worth the search
                    rows.append((key, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "pos", "picked", "error"])

    return prompts.select(F.col("key").cast("string").alias("key"), "prompt").mapInPandas(run, "key string, pos int, picked string, error string")


def search_by_model(docs: DataFrame, nodes: DataFrame, flats: DataFrame, query: str, client: Model, batch: int = 50) -> DataFrame:
    """Search with a model's choices: doc_id, doc_name, pos, content, error.

    The model sees names and summaries in batches and picks documents; if no pick exists, all are taken.
    For each picked tree it sees the titles of the nodes and picks some; flat documents come whole. A
    document whose call fails is a row with its error and without content, and the others stay.
    """
    q = query.translate(str.maketrans(T.DASHES, "-" * len(T.DASHES)))
    lines = docs.select(F.pmod(F.xxhash64("doc_id"), F.ceil(F.lit(docs.count()) / batch)).alias("key"), F.struct("doc_id", "doc_name", "summary").alias("d"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda d: F.concat_ws("\t", d["doc_id"].cast("string"), d["doc_name"], d["summary"])), "\n")
    asked = lines.groupBy("key").agg(F.concat(F.lit(f"documents for: {q}\n"), listed).alias("prompt"))
    answers = model_picks(asked, client).filter("pos IS NOT NULL")
    picks = answers.select(F.col("picked").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "pos")
    chosen = pick_in_order(docs.select("doc_id", "doc_name"), picks).withColumn("pos", F.coalesce("pos", F.lit(0)))
    trees = nodes.join(chosen, "doc_id").join(flats.select("doc_id"), "doc_id", "left_anti")
    titles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "node_id", "title"))), lambda n: F.concat_ws("\t", n["node_id"], n["title"])), "\n")
    answers = model_picks(trees.groupBy(F.col("doc_id").alias("key")).agg(F.concat(F.lit(f"nodes for: {q}\n"), titles).alias("prompt")), client)
    of = F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    texts = texts_of_picks(nodes, answers.filter("pos IS NOT NULL").select(of, "pos", F.col("picked").alias("node_id")))
    failed = answers.filter("pos IS NULL").select(of, F.lit(None).cast("string").alias("content"), "error")
    found = texts.unionByName(flats.join(chosen, "doc_id", "left_semi").select("doc_id", "content")).withColumn("error", F.lit(None).cast("string"))
    return chosen.join(found.unionByName(failed), "doc_id").select("doc_id", "doc_name", "pos", "content", "error")


def search(docs: DataFrame, nodes: DataFrame, flats: DataFrame, query: str, top_docs: int = 5, top_nodes: int = 5) -> DataFrame:
    """docs: doc_id, doc_name, summary. Prefilter by the summary, nodes by title and text, flat
    documents by their whole text: doc_id, doc_name, pos, content. The texts are read in the last join
    only. top_docs and top_nodes are the feature: what a model would be asked for."""
    q = query.translate(str.maketrans(T.DASHES, "-" * len(T.DASHES)))
    scored = docs.withColumn("score", lexical_score(F.concat_ws(" ", "doc_name", "summary"), q)).filter("score > 0")
    top = scored.orderBy(F.desc("score"), "doc_id").limit(top_docs).select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("pos"))
    chosen = pick_in_order(docs.select("doc_id", "doc_name"), top)
    ids = chosen.select("doc_id")
    slim = nodes.join(ids, "doc_id", "left_semi").select("doc_id", "node_id", "ord", lexical_score(F.concat_ws(" ", "title", "text"), q).alias("score"))
    rank = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord")
    picks = slim.filter("score > 0").withColumn("pos", F.row_number().over(rank)).filter(F.col("pos") <= top_nodes).select("doc_id", "pos", "node_id")
    texts = texts_of_picks(nodes, picks).unionByName(flats.join(ids, "doc_id", "left_semi").select("doc_id", "content"))
    return chosen.join(texts, "doc_id").select("doc_id", "doc_name", F.coalesce("pos", F.lit(0)).alias("pos"), "content")
