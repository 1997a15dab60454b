"""The quality gate over node tables, and where a document goes after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T

MIN_NODES, MIN_DEPTH, MAX_CONTROL_SHARE = 3, 2, 0.05
BROKEN = "[\\x00\\uFFFD]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def verdict(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document: node_count, depth, garbled, ok, reason ('' if ok); first failure wins. The
    texts are summed up per node, so nothing is concatenated."""
    body = F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    sums = nodes.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.max("depth").alias("d"),
        F.sum(F.length(body)).alias("chars"),
        F.sum(F.length(T.strip(body))).alias("solid"),
        F.sum(T.count(body, BROKEN)).alias("broken"),
        F.sum(T.count(body, CONTROL)).alias("control"),
    )
    own = docs.select("doc_id").join(sums, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    garbled = (zero("solid") == 0) | (zero("broken") > 0) | (zero("control") > zero("chars") * F.lit(MAX_CONTROL_SHARE))
    graded = own.select("doc_id", zero("n").cast("int").alias("node_count"), zero("d").cast("int").alias("depth"), garbled.alias("garbled"))
    reason = (
        F.when(F.col("node_count") < MIN_NODES, F.lit(f"node_count<{MIN_NODES}"))
        .when(F.col("depth") < MIN_DEPTH, F.lit(f"depth<{MIN_DEPTH}"))
        .when(F.col("garbled"), F.lit("garbling"))
        .otherwise(F.lit(""))
    )
    return graded.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")


def route(ok: Column, reason: Column, md: Column, is_pdf: Column, routing: Column | None = None, retried: Column | None = None) -> Column:
    """tree, retry (a garbled PDF, once), flat (no tree but real text) or reject."""
    on = F.lit(True) if routing is None else routing
    again = F.lit(False) if retried is None else retried
    real = T.strip(F.coalesce(md, F.lit(""))) != ""
    return (
        F.when(ok, F.lit("tree"))
        .when((reason == "garbling") & is_pdf & ~again, F.lit("retry"))
        .when((reason != "garbling") & on & real, F.lit("flat"))
        .otherwise(F.lit("reject"))
    )
