"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources weigh 3, 1, 2, repeating in code-point order, share a multiple of all words, and are
capped at `most` times their own words; what a cap leaves over is reshared by weight. That fixed
point is a water level, found in closed form from prefix sums over the capped sources.

Sampling: a document of quality weight w and uniform u gets the key -ln(u) / w. In key order within
its source, sizes are prefix-summed; whole epochs over the source come first, and the fraction that
is left takes the documents whose prefix stays nearest to the budget. The order is computed in
key-range buckets with offsets, so no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty, word_count

#: Characters that speak against a document.
NOISE = r"[0-9#*$%&|<>{}]"
#: Weights of sources, repeating.
WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """0.25 to 1: one less twice the share of digits and symbols."""
    share = F.regexp_count(text, F.lit(NOISE)) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(2.0) * share)


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from 48 bits of an MD5, the same in every engine and run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """sources: source, source_size. Adds target. One row per source, so the few windows over all
    sources are small whatever the documents are."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), k + 1).cast("double"))
    everything = Window.partitionBy()
    fill = Window.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(float(most)) * F.col("source_size")
    leveled = ranked.withColumn("cap", cap).withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("w").over(rest),
    )
    # Levels fall from the first source, in order of cap / w, that its level doesn't fill: that level holds.
    water = F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(everything)
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(water * F.col("w"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
    rows_per_bucket: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted) [, row].

    A null source is a source, last in order. A null text has size 0. Empty documents take nothing.
    Rows equal in id and size share a key; ties are broken by id, then size, then row_col, a key of each
    row. Null ids share one random number. An empty table gives an empty result; further columns are ignored.
    """
    text = text_or_empty(text_col)
    row = (F.lit(0) if row_col is None else F.col(row_col)).alias("row")
    # Texts are read once: what follows works on ids, sizes and keys.
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"),
        row,
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
        (-F.log(uniform(F.col(id_col), seed)) / (quality_weight(text) if weight is None else weight)).alias("key"),
    ))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), share, most)
    plan = targets.join(sizes.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_bucket)).alias("buckets"),
    )
    # Sources are few beside documents; Spark broadcasts the plan only below its checked threshold.
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets")).cast("long")
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    begun = begun.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    start = F.col("own") + F.col("offset")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - epochs * F.col("source_size")
    extra = F.when(start * 2 + F.col("size") <= left * 2, F.col("size")).otherwise(F.lit(0))
    taken = (epochs * F.col("size") + extra).cast("long").alias("taken")
    return begun.select("doc_id", "size", "source_size", "target", taken, *([] if row_col is None else [F.col("row").alias(row_col)]))
