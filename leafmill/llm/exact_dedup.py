"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes in groups.

Only (id, hash, digest) rows are shuffled to form groups. A text moves only if its hash may stand for
several rows: the hashes of such groups set the bits of a bitmap, and rows whose bit is not set stay
where they are. Of what moves, the smallest and the largest text of a group are the same exactly if
all are; both are found with map-side aggregation, so the copies of a hot group never meet in one
task. A hash that stands for different texts is regrouped by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, first_row, in_bitmap, join_groups, text_or_empty

def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_fn: Callable[[Column], Column] = content_hash,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 [, row].

    keep: 'smallest' or 'largest' id of a group stays. A null text is an empty text. A document is
    known by its id: repeated rows of one id and text count in group_size and share a verdict. Rows
    with a null id never stay while their group has an id; a group of null ids only keeps them. With
    row_col, a key of each row, exactly one row of a group stays: of those with the id that stays,
    the one with the least (largest) key. An empty table gives an empty result. Further columns are ignored.
    """
    key = F.lit(0).alias("row") if row_col is None else F.col(row_col).alias("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), key, text_or_empty(text_col).alias("t"))
    rows = rows.withColumn("h", hash_fn(F.col("t")))

    def grouped(x: DataFrame) -> DataFrame:
        return cut(x.groupBy("h").agg(F.count("*").alias("group_size"), first_row("doc_id", "row", keep == "smallest").alias("stays")).filter("group_size > 1"))

    slim = cut(rows.select("doc_id", "row", "h", F.unhex(F.sha2("t", 256)).alias("digest")))
    total = slim.count()
    groups = grouped(slim)
    bodies = in_bitmap(rows.select("h", "t"), groups.select("h"), "h", groups.count())
    collided = bodies.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("z")).filter("a <> z").select("h")
    if not collided.isEmpty():
        # Different texts under one hash: there the text itself completes the key.
        slim = rows.join(collided.withColumn("c", F.lit(True)), "h", "left").select(
            "doc_id",
            "row",
            F.when(F.col("c"), F.concat(F.lit(b"\x01"), F.encode("t", "UTF-8"))).otherwise(F.concat(F.lit(b"\x00"), "h")).alias("h"),
            F.unhex(F.sha2("t", 256)).alias("digest"),
        )
        groups = grouped(slim)

    joined = join_groups(slim, groups, "h", "group_size", total, F.concat_ws("~", F.col("doc_id").cast("string"), F.col("row").cast("string")))
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("stays.id"))
    own = F.lit(True) if row_col is None else alone | (F.col("row") == F.col("stays.row"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & own).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if row_col is None else [F.col("row").alias(row_col)]),
    )
