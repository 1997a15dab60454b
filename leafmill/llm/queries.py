"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .chat import chat_windows, read_windows
from .common import table
from .exact_dedup import exact_dedup
from .mixing import mix
from .quality import quality_rules
from .sharding import shard_rows
from .simhash import simhash_components
from .substring import substring_dedup
from .suffix import suffix_dedup
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    read = read_windows(chat_windows(turns.unionByName(extra)))
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("ws"), F.sum("formatted_chars").alias("formatted_chars")
    )
    turn_list = F.flatten(F.transform("ws", lambda w: w["turns"]))
    loss = F.array_join(F.transform("ws", lambda w: w["loss_text"]), "")
    return whole.select(
        "conv_id",
        F.size(turn_list).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turn_list, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars"),
        F.size("ws").cast("long").alias("n_windows"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP5 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


#: WORD, START and END are as in common and chat; DuckDB's \x20\x09-\x0D is the same class.
OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), (length(text) + 7) // 8)::BIGINT + 4 AS tokens,
         length(role) + length(text) + length(text) - length(replace(text, '\', ''))
           + (length(text) - length(replace(text, '<|', ''))) // 2 + 24 AS chars
  FROM turns
), placed AS (
  SELECT *, row_number() OVER c - 1 AS pos, sum(tokens) OVER (c ROWS UNBOUNDED PRECEDING) - tokens AS start,
         first_value(CASE WHEN role = 'system' THEN tokens END) OVER c AS sys_tokens,
         first_value(CASE WHEN role = 'system' THEN chars END) OVER c AS sys_chars
  FROM sized WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), strided AS (SELECT *, greatest(256, 1792 - coalesce(sys_tokens, 0)) AS stride FROM placed
), celled AS (
  SELECT *, (start // stride)::BIGINT AS cell, ((start + tokens - 1) // stride)::BIGINT > (start // stride)::BIGINT AS crosses FROM strided
), crossed AS (
  SELECT *, cell * 2 + crosses::INT AS win, min(CASE WHEN crosses THEN start END) OVER (PARTITION BY conv_id, cell) AS cross_at FROM celled
), used AS (
  SELECT *, CASE WHEN pos = 0 AND sys_tokens IS NOT NULL THEN NULL
         WHEN crosses AND tokens <= 256 THEN ((start + tokens) // stride)::BIGINT * 2
         WHEN NOT crosses AND cross_at - start <= 256 THEN win + 1
         WHEN NOT crosses AND cross_at IS NULL AND (cell + 1) * stride - start <= 256 THEN win + 2 END AS again
  FROM crossed
), windows AS (
  SELECT conv_id, win, sum(chars) AS chars, min(pos) AS first_at, any_value(sys_chars) AS sys_chars FROM used GROUP BY ALL
), repeats AS (
  SELECT conv_id, again AS win, sum(chars) AS chars FROM used WHERE again IS NOT NULL GROUP BY ALL
), formatted AS (
  SELECT w.conv_id, sum(w.chars + coalesce(r.chars, 0) + CASE WHEN w.first_at > 0 THEN coalesce(w.sys_chars, 0) ELSE 0 END) AS chars, count(*) AS n
  FROM windows w LEFT JOIN repeats r USING (conv_id, win) GROUP BY 1
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss
  FROM turns GROUP BY 1
)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars, n AS n_windows
FROM whole JOIN formatted USING (conv_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP6 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) AS r(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS o(k) GROUP BY 1
), lines AS (
  SELECT doc_id, line, len(lw) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[!?]{2,}')) AS shouts,
         len(list_filter(lw, lambda x: regexp_full_match(x, '[|>»·•/]+'))) AS bars,
         NOT regexp_matches(line, '[\p{L}\p{N}]') AS mute,
         regexp_matches(line, '(?i)(accept cookies|all rights reserved|privacy policy|terms of (use|service)|sign up|log ?in|subscribe|click here|enable javascript|back to top|skip to content|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|jetzt anmelden|hier klicken|nach oben|zum inhalt springen|tous droits réservés|politique de confidentialité|conditions d.utilisation|accepter les cookies|cliquez ici|haut de page|aller au contenu|todos los derechos reservados|política de privacidad|términos de uso|aceptar cookies|haga clic aquí|volver arriba|saltar al contenido)') AS furniture
  FROM (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM docs, unnest(string_split(t, chr(10))) AS s(line))
), judged AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
         sum(CASE WHEN symbols > n * 0.3 OR shouts > n * 0.3 OR mute OR bars > n * 0.2 OR (n <= 30 AND furniture) THEN n ELSE 0 END) AS lost
  FROM lines WHERE n > 0 GROUP BY 1
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(lost, 0))::BIGINT AS kept_words
  FROM words LEFT JOIN judged USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_words >= n_words * 0.7 AS kept
FROM base
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / greatest(0.25::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * (len(regexp_extract_all(coalesce(text, ''), '[0-9#*$%&|<>{}]'))::DOUBLE
             / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM docs GROUP BY 1
), leveled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN cap >= level * w THEN level END) OVER () * w, cap)) AS target FROM leveled
), begun AS (
  SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN start * 2 + size <= 2 * (target - epochs * source_size) THEN size ELSE 0 END)::BIGINT AS taken
FROM begun
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4, "op5_exact_dedup": OP5, "op6_quality": OP6, "op8_mixing": OP8}
