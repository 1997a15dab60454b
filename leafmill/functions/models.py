"""Model calls as Arrow functions over an injected client; deterministic stand-ins by default."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Complete = Callable[[str], str]


def first_sentence(prompt: str) -> str:
    """The stand-in for a completion: what is before the first full stop, 200 characters at most."""
    return prompt.split(".")[0][:200]


def complete(prompt: Column, client: Complete = first_sentence, fallback: str | None = None) -> Column:
    """A completion per row; a failing call gives the fallback, never a failing job."""

    def one(p: str | None) -> str | None:
        try:
            return None if p is None else client(p)
        except Exception:  # what the model can't do the row can't help
            return fallback

    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return run(prompt)


def caption(source: Column, client: Complete = lambda src: "image") -> Column:
    return complete(source, client, fallback="image")


def bounded(df: DataFrame, calls: int) -> DataFrame:
    """At most so many model calls at once: one per partition."""
    return df.repartition(calls)


def provider_model(model: Column, url: Column) -> Column:
    """Model name without its provider's prefix where the endpoint is that provider's."""
    own = F.lower(F.coalesce(url, F.lit(""))).contains(".azure.com")
    return F.when(own, F.regexp_replace(model, "^azure/", "")).otherwise(model)


def provider(url: Column) -> Column:
    """Whose endpoint it is."""
    return F.when(F.lower(F.coalesce(url, F.lit(""))).contains(".azure.com"), "azure").otherwise("openai")


def config_error(model: Column, url: Column, key: Column) -> Column:
    """What keeps a configuration from starting, null if nothing does. Keys never show in it."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(model), "no model").when(blank(key), F.concat(F.lit("no key for "), provider(url))).when((provider(url) == "azure") & blank(url), "no endpoint")


def headroom(available: Column, floor: Column) -> Column:
    """Whether a call may start: enough memory is free, or nobody knows how much is."""
    return F.coalesce(available >= floor, F.lit(True))


def register_tools(spark: SparkSession, nodes: DataFrame) -> None:
    """SQL access by name: the view `nodes`, and the table function find_words(text), which gives each
    word of a text with its place. It is a SQL function, so no text crosses to Python."""
    nodes.createOrReplaceTempView("nodes")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION find_words(body STRING) RETURNS TABLE (pos INT, word STRING) "
        r"RETURN SELECT w.pos, w.col FROM (SELECT posexplode(regexp_extract_all(coalesce(find_words.body, ''), '\\S+', 0))) AS w"
    )
