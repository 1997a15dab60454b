"""Shared pieces of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; one of our own only on a local master where none is
    set (tests). A cluster without one is refused: its executors share no folder we could pick."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if (at := sc.getConf().get("spark.checkpoint.dir", None)) is None:
        if have.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if have.isEmpty():
        sc.setCheckpointDir(at)
    return at


#: Files of the checkpoints made inside `cuts_released`, where one is open.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if (made := _MADE.get()) is not None:
        at = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        made += [at.get()] if at.isDefined() else []
    return out


def remove_folder(spark: SparkSession, at: str) -> None:
    """Remove a folder by the file system of its path, which need not be a local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cuts_released(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside go at the end, when their result has been written elsewhere."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get() or []
        _MADE.reset(token)
        for at in made:
            remove_folder(spark, at)


def hot_limit(total: int) -> int:
    """Groups above this size are hot: at most 1,000 of them can exist among `total` rows, so a
    table with one row per hot group may be broadcast."""
    return max(1_000, total // 1_000)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, unique: Column) -> DataFrame:
    """Left-join one row per group back onto its member rows without a hot task.

    Hot groups (see hot_limit) are joined by broadcast, at most 1,000 rows; their members then get a
    key of their own (`unique`, text) for the shuffled join of all others, so they spread evenly.
    """
    values = [c for c in groups.columns if c != key]
    limit = hot_limit(total)
    hot = groups.filter(F.col(size) > limit).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = groups.filter(F.col(size) <= limit).select(F.hex(key).alias("_ck"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hk").isNotNull(), F.concat(F.lit("~"), unique)).otherwise(F.hex(key)))
    out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])


def parts(total: int, each: int, most: int = 65_536) -> int:
    return max(1, min(most, math.ceil(total / each)))


#: Row keys that may be broadcast: 16 bytes each.
MAX_BROADCAST_KEYS = 500_000


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs as one struct, `_doc`, and a key that names each row, equal ones too: its file and its place
    there, which are the same however often and wherever a task runs again. What doesn't come from
    files is numbered once, in a checkpoint."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.select(doc, key.alias(name))
        except AnalysisException:  # not a table of files
            pass
    key = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return cut(docs.select(doc, key.alias(name)))


def without_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows (_doc, _row) as documents again, without those whose key is in dropped. Few keys are
    broadcast, so that the documents stay where they are; many are joined by a shuffle."""
    gone = cut(dropped.select(F.col("_row").alias("_gone")))
    few = gone.count() <= MAX_BROADCAST_KEYS
    return rows.join(F.broadcast(gone) if few else gone, F.col("_row") == F.col("_gone"), "left_anti").select("_doc.*")


def first_row(id_col: str, row_col: str, smallest: bool = True) -> Column:
    """Aggregate: the row (id, row) with the least (or largest) id, then key; null ids come last."""
    known = F.col(id_col).isNull() if smallest else F.col(id_col).isNotNull()
    return (F.min if smallest else F.max)(F.struct(known.alias("known"), F.col(id_col).alias("id"), F.col(row_col).alias("row")))


#: Bits of the bitmap: at least 16 a group, and at most 2**29 (64 MiB in all, the bound of its broadcast).
#: A full bitmap lets more texts move than need to, never fewer.
BITS_A_GROUP, LEAST_BITS, MOST_BITS = 16, 15, 29


def in_bitmap(rows: DataFrame, keys: DataFrame, column: str, n: int) -> DataFrame:
    """The rows whose `column` is among the n values of keys, and a few more."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_A_GROUP * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    bitmap = keys.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_part"))
    bitmap = bitmap.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    placed = rows.withColumn("_at", place).join(F.broadcast(bitmap), F.bitmap_bucket_number("_at") == F.col("_part"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.filter(F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(rows.columns)
