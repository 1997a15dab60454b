"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A uniform random permutation cut into shards sends hypergeometrically distributed numbers of rows
from each source partition to each shard. The matrix of those numbers is drawn first (one number per
partition and shard, on the driver; partitions are at most 65,536). Then each partition permutes its
rows and cuts them by its row of the matrix, the rows are exchanged, and each shard permutes what it
got. Only ids and sizes move, not texts.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, text_or_empty


def draw_hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw by inversion, walking outwards from the mode; about sqrt(draws) steps."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lg = math.lgamma
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_p(k: int) -> float:
        return (
            lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(draws - k + 1) - lg(bad - draws + k + 1)
            - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1)
        )

    u = rng.random()
    left = right = mode
    p_left = p_right = math.exp(log_p(mode))
    u -= p_left
    while u > 0 and (left > low or right < high):
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
    return mode


def draw_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each source partition the rows it sends to each shard; columns sum to the shard sizes,
    which differ by one at most."""
    rng, total = random.Random(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in sizes:
        row, rest = [], sum(room)
        for s in range(shards):
            rest -= room[s]
            row.append(x := draw_hypergeometric(rng, room[s], rest, n))
            n -= x
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_partition: int = 5_000,
) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text, null 0, plus 1), text_crc32,
    law 'rows', shard, slot (gapless from 0 in each shard), grown_shard (null).

    Shard sizes differ by one at most. A source partition is a class of a hash of id, size and
    checksum, so reruns and retries agree. Rows equal in all three are interchangeable. Null ids
    and texts are shuffled like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    total = docs.count()
    n = parts(total, rows_per_partition)
    bits = max(0, math.ceil(math.log2(max(1, total / shards / rows_per_partition))))
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    mixed = lambda k: F.xxhash64(F.lit(seed + k), "doc_id", "size", "text_crc32")
    rows = cut(rows.withColumn("p", F.pmod(mixed(0), F.lit(n)).cast("int")))  # texts are read once
    found = {r["p"]: r["count"] for r in rows.groupBy("p").count().collect()}
    matrix = draw_matrix([found.get(p, 0) for p in range(n)], shards, seed)
    ends = [{"q": p, "ends": [sum(row[: s + 1]) for s in range(shards)]} for p, row in enumerate(matrix)]
    cuts = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<q:int,ends:array<bigint>>>"))
    )

    tie = ("doc_id", "size", "text_crc32")
    local = Window.partitionBy("p").orderBy(mixed(1), *tie)
    sent = rows.withColumn("rank", F.row_number().over(local)).join(F.broadcast(cuts), F.col("p") == F.col("q"))
    sent = sent.select(
        *tie,
        F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"),
        mixed(2).alias("order"),
    ).withColumn("piece", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))

    counts = sent.groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    again = Window.partitionBy("shard", "piece").orderBy("order", *tie)
    return (
        sent.withColumn("k", F.row_number().over(again))
        .join(offsets, ["shard", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("k") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
