"""Section trees as node tables.

With last_k the place of the latest earlier heading of level k, a heading's parent is the latest of
those of smaller levels, and its depth counts the levels whose latest heading comes after all those of
still smaller levels. Levels are one to six, so five running maxima give the tree, without recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

LEVELS = range(1, 6)


def link(heads: DataFrame) -> DataFrame:
    """heads: doc_id, ord, level, ... Adds parent_ord (null at the top) and depth (from 1)."""
    earlier = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("ord"))).over(earlier) for k in LEVELS}
    out = heads.select("*", *[last[k].alias(f"_l{k}") for k in LEVELS])
    parent = F.greatest(F.lit(None), *[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in LEVELS])
    zero = lambda k: F.coalesce(f"_l{k}", F.lit(0))
    depth = F.lit(1)
    for k in LEVELS:
        below = F.greatest(F.lit(0), F.lit(0), *[zero(j) for j in LEVELS if j < k])
        depth = depth + ((F.col("level") > k) & (zero(k) > below)).cast("int")
    return out.withColumn("parent_ord", parent).withColumn("depth", depth).drop(*[f"_l{k}" for k in LEVELS])


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, text: from a heading to the next one of any depth, put together from
    its own lines, so a section costs its own size and not its document's."""
    from leafmill.operators.lines import explode_lines, mark_fences, running

    own = mark_fences(explode_lines(docs)).withColumn("s", T.strip(F.col("line")))
    head = ~F.col("is_fence") & ~F.col("in_fence") & F.col("s").rlike(T.HEADING)
    numbered = own.withColumn("head", head).withColumn("ord", F.sum(F.col("head").cast("int")).over(running()).cast("int"))
    first = lambda k: F.max(F.when(F.col("head"), F.regexp_extract("s", T.HEADING, k)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    grouped = numbered.filter("ord > 0").groupBy("doc_id", "ord").agg(F.length(first(1)).alias("level"), T.strip(first(2)).alias("title"), body.alias("body"))
    more = F.lead("ord").over(Window.partitionBy("doc_id").orderBy("ord")).isNotNull()
    return grouped.select("doc_id", "ord", "level", "title", F.when(more, F.concat("body", F.lit("\n"))).otherwise(F.col("body")).alias("text"))


def build_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, md to nodes: doc_id, node_id (pre-order, four digits), ord, parent_ord, level, depth, title, text."""
    number = (F.col("ord") - 1).cast("string")
    return link(sections(docs)).select(
        "doc_id", F.lpad(number, F.greatest(F.lit(4), F.length(number)), "0").alias("node_id"), "ord", "parent_ord", "level", "depth", "title", "text"
    )


def node_map(nodes: DataFrame) -> DataFrame:
    """One row per (doc_id, node_id): the values of the last of it, at the place of the first. Nodes
    without an id are left out."""
    values = [c for c in nodes.columns if c not in ("doc_id", "node_id", "ord")]
    return (
        nodes.filter("node_id IS NOT NULL AND node_id <> ''")
        .groupBy("doc_id", "node_id")
        .agg(F.min("ord").alias("ord"), F.max_by(F.struct(*values), "ord").alias("v"))
        .select("doc_id", "node_id", "ord", "v.*")
    )


def without_text(nodes: DataFrame) -> DataFrame:
    return nodes.drop("text")


def nested_json(nodes: DataFrame, levels: int = 6) -> DataFrame:
    """doc_id, structure: the nested JSON of a tree, folded from the deepest level up; for the edge."""
    rows = nodes.select("doc_id", "ord", "parent_ord", "depth", "node_id", "title")
    own = lambda inner: F.concat(
        F.lit('{"title":'), F.to_json(F.array("title")).substr(F.lit(2), F.length(F.to_json(F.array("title"))) - 2),
        F.lit(',"node_id":"'), F.col("node_id"), F.lit('","nodes":['), F.coalesce(inner, F.lit("")), F.lit("]}"),
    )
    below = None
    for d in range(levels, 0, -1):
        here = rows.filter(F.col("depth") == d)
        if below is None:
            here = here.withColumn("json", own(F.lit("")))
        else:
            here = here.join(below, ["doc_id", "ord"], "left").withColumn("json", own(F.col("inner")))
        key = "parent_ord" if d > 1 else None
        ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ",")
        if key:
            below = here.groupBy("doc_id", F.col(key).alias("ord2")).agg(ordered.alias("inner")).withColumnRenamed("ord2", "ord")
        else:
            below = here.groupBy("doc_id").agg(F.concat(F.lit("["), ordered, F.lit("]")).alias("structure"))
    return below


def summaries(nodes: DataFrame, summary: Callable[[Column], Column], least_words: int = 200) -> DataFrame:
    """Adds summary: a short text is its own, a longer one is given to the model."""
    long = F.regexp_count("text", F.lit("\\S+")) >= least_words
    return nodes.withColumn("summary", F.when(long, summary(F.when(long, F.col("text")))).otherwise(F.col("text")))
