"""Markdown documents as lines and back, and the headings among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions import text as T


def running() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def explode_lines(docs: DataFrame, md: str = "md") -> DataFrame:
    """doc_id, pos (from 0), off (0-based character offset), line."""
    parts = F.split(F.coalesce(F.col(md), F.lit("")), "\n", -1)
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "line"))
    before = F.sum(F.length("line") + 1).over(running()) - F.length("line") - 1
    return rows.select("doc_id", "pos", before.cast("int").alias("off"), "line")


def implode_lines(lines: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("md"))


def mark_fences(lines: DataFrame) -> DataFrame:
    """Adds is_fence and in_fence, by the parity of the fences so far."""
    fence = T.strip(F.col("line")).startswith("```")
    marked = lines.withColumn("is_fence", fence)
    return marked.withColumn("in_fence", F.sum(F.col("is_fence").cast("int")).over(running()) % 2 == 1)


def headings(lines: DataFrame) -> DataFrame:
    """Headings outside fences: doc_id, ord (from 1), pos, off, level, title."""
    own = mark_fences(lines).withColumn("s", T.strip(F.col("line")))
    own = own.filter(~F.col("is_fence") & ~F.col("in_fence") & F.col("s").rlike(T.HEADING))
    numbered = Window.partitionBy("doc_id").orderBy("pos")
    return own.select(
        "doc_id",
        F.row_number().over(numbered).alias("ord"),
        "pos",
        "off",
        F.length(F.regexp_extract("s", T.HEADING, 1)).alias("level"),
        T.strip(F.regexp_extract("s", T.HEADING, 2)).alias("title"),
    )
