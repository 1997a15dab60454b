"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and reads it again, so a stage never repeats what came before it. All stages but
the last return the columns of documents, whatever their names. An empty table stays empty.

Rows are judged one by one: a key of each row (its file and place) goes through the operators, so of
repeated rows of one id, or of rows without an id, exactly those stay that the verdicts name.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import bpe_digests
from leafmill.llm.common import cuts_released, numbered, remove_folder, shared_dir, table, without_rows
from leafmill.llm.exact_dedup import exact_dedup
from leafmill.llm.mixing import mix
from leafmill.llm.near import near_components
from leafmill.llm.quality import keep_clean


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go (null and empty texts too); the others lose the lines that fail,
    and n_chars is the length of what is left. Very long texts are judged whole; equal rows alike."""
    return keep_clean(docs, length_col="n_chars")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty), one row stays: that of the smallest id, a null id only where
    no other has the text, and of repeated rows of that id the first."""
    rows = numbered(docs)
    judged = exact_dedup(rows.select("_doc.doc_id", "_doc.text", "_row"), keep="smallest", row_col="_row")
    return without_rows(rows, judged.filter("NOT kept").select("_row"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more), one row stays,
    chosen as in exact_stage. Texts without words are one component."""
    rows = numbered(docs)
    judged = near_components(rows.select("_doc.doc_id", "_doc.text", "_row"), row_col="_row")
    return without_rows(rows, judged.filter("NOT kept").select("_row"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it: none, once or twice. Rows without words are never taken."""
    rows = numbered(docs)
    taken = mix(rows.select("_doc.doc_id", "_doc.text", "_doc.source", "_row"), row_col="_row").filter("taken > 0")
    times = taken.select(F.col("_row").alias("_taken"), F.expr("cast(taken div size AS int)").alias("_times"))
    found = rows.join(times, F.col("_row") == F.col("_taken"))
    return found.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).select("_doc.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix, repeated ones too; a null text is empty."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mix_stage),
    ("bpe_encoding", encode_stage),
]

#: Near copies and BPE have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What earlier stages wrote goes once the next one has been written;
    the folder of the last holds the result and is the caller's to remove."""
    docs = table(spark, sf_dir, "documents")
    at, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        with cuts_released(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
