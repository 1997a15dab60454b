"""Line-first cleaning: judge lines, remove those that fail, reject documents that lose too much.

Everything is a projection over one row: no shuffle, whole texts, any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

SYMBOL = r"[#*$%&|<>]"
#: Line rules, as shares of the line's words.
MAX_SYMBOL_SHARE = 0.3
MAX_SHOUT_SHARE = 0.3
#: A line without any letter or digit is punctuation only.
SAYS = r"[\p{L}\p{N}]"
MAX_NAVIGATION_SHARE = 0.2
#: Phrases of page furniture; a line of at most so many words that has one goes.
BOILERPLATE = (
    r"(?iu)(accept cookies|all rights reserved|privacy policy|terms of (use|service)|sign up|log ?in|subscribe|click here|enable javascript|back to top|skip to content"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|jetzt anmelden|hier klicken|nach oben|zum inhalt springen"
    r"|tous droits réservés|politique de confidentialité|conditions d.utilisation|accepter les cookies|cliquez ici|haut de page|aller au contenu"
    r"|todos los derechos reservados|política de privacidad|términos de uso|aceptar cookies|haga clic aquí|volver arriba|saltar al contenido)"
)
BOILERPLATE_WORDS = 30
#: A document stays if so much of its words stays.
MIN_KEPT_SHARE = 0.7


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def line_fails(line: Column, n: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for a line of n words; false for one without."""
    over = lambda pattern, share: F.regexp_count(line, F.lit(pattern)) > n * F.lit(share)
    return (n > 0) & (
        over(SYMBOL, MAX_SYMBOL_SHARE)
        | over(r"[!?]{2,}", MAX_SHOUT_SHARE)
        | ~line.rlike(SAYS)
        | over(r"(?<![^\x20\x09-\x0D])[|>»·•/]+(?![^\x20\x09-\x0D])", MAX_NAVIGATION_SHARE)
        | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


def clean_lines(text: Column) -> Column:
    """The text without the lines that fail."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~_let(_count(x), lambda n: line_fails(x, n))), "\n")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sorts the windows, keeps the starts of
    those equal to a neighbour, and adds up what each start covers before the next one."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")
        ),
    )
    return F.when(F.size(words) > 3, _covered(F.sort_array(windows))).otherwise(F.lit(0))


def _covered(ordered: Column) -> Column:
    # One row's sorted windows are bound to a name once: let(x, f) is transform over a single value.
    def starts(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["g"] == F.get(s, j)["g"]
        hit = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def width(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )

    return _let(_let(ordered, starts), width)


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept_words, kept [, clean_text].

    A null or empty text has no words and fails. Extra columns are ignored; repeated rows are judged
    alike; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    one = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    one = one.withColumn("w", _words(F.col("t"))).withColumn("lines", F.split("t", "\n", -1))
    full = F.filter("lines", lambda x: x.rlike(WORD))
    lost_of = lambda x: _let(_count(x), lambda n: F.when(line_fails(x, n), n).otherwise(F.lit(0)))
    lost = F.aggregate(F.transform("lines", lost_of), F.lit(0), lambda a, x: a + x)
    base = one.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        (F.size("w") - lost).cast("long").alias("kept_words"),
        *([clean_lines(F.col("t")).alias("clean_text")] if with_text else []),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    kept = ~failed & (F.col("kept_words") >= F.col("n_words") * F.lit(MIN_KEPT_SHARE))
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words",
        failed.alias("base_failed"), kept.alias("kept"), *(["clean_text"] if with_text else []),
    )


def keep_clean(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows whose text passes, without the lines that fail; a text without such lines stays as it
    is. length_col, if there is one, becomes the text's length in code points where lines went. The
    verdict is computed in place, without a join back, so each row is judged by itself.

    Null and empty texts fail, and an empty table gives an empty result. The row number keeps the
    filter above the projection that computes the verdict: pushed below, it would evaluate every
    array expression again for each use.
    """
    ids = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("t"))
    judged = quality_rules(ids, id_col="_doc", text_col="t", with_text=True)
    judged = judged.select(F.col("doc_id").alias("_doc"), "kept", "clean_text", (F.col("kept_words") < F.col("n_words")).alias("less"), F.monotonically_increasing_id().alias("at"))

    def column(c: str) -> Column:
        own = F.col(f"_doc.`{c}`")
        if c == text_col:
            return F.col("clean_text").alias(c)
        if c == length_col:
            return F.when(F.col("less"), F.length("clean_text").cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return judged.filter("kept AND at >= 0").select([column(c) for c in docs.columns])
