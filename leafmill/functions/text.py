"""Scalar functions over titles, lines, tables and names, as Column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Characters, words and patterns that results depend on.
DASHES = "‐‑–—−"  # hyphen, non-breaking hyphen, en dash, em dash, minus
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ARABIC = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
LATIN = "[A-Za-zÀ-ɏ]"
GERMAN = "[äöüÄÖÜß]"
PART_WORDS = "(?U)^(?:ال)?(?:باب|فصل|قسم|جزء)\\b"
ARTICLE_WORDS = "(?U)^(?:ال)?مادة\\b"
SECTION_CODE = "(?iU)^Abschnitt\\s+[A-Z]?\\d"
PART_CODE = "(?iU)^(?:Teil|Anhang|Kapitel|Abschnitt)\\b"
HYPHEN_CLAUSE = "(?U)^[A-Z]\\d+-\\d+(\\.\\d+)?(?=[ \\t]|$)"
DOTTED_CLAUSE = "(?U)^([A-Z](?:\\.\\d+)+)(?=[ \\t.:]|$)"
PARAGRAPH = "(?U)^((?:§\\s*)?\\d+(?:\\.\\d+)+)(?=[ \\t.:]|$)"
LABEL_WORDS = "(?iU)^(teil|anhang|abschnitt|kapitel)\\b"
ARABIC_LABEL_WORDS = "(?U)^(?:ال)?(?:مادة|باب|فصل|قسم|جزء|مرسوم)\\b"
NUMERIC_CELL = "(?U)^[\\d٠-٩][\\d٠-٩\\s/\\-.:,]*$"
HEADING = "^(#{1,6})\\s+(.+)$"
NUMBERED_LINE = "(?U)^\\s*\\d+(?:\\.\\d+)*[.)]?(?:\\s+\\S.*)?$"
TITLE_LINE = "(?U)^\\s{0,3}#{1,6}\\s+(.+?)\\s*#*\\s*$"
MIN_TITLE_CHARS = 8
MAX_LABEL_CHARS = 14


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once per row, however often f names it and wherever the optimizer
    moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends, the Unicode kinds too."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def normalize_dashes(x: Column) -> Column:
    return F.translate(x, DASHES, "-" * len(DASHES))


def western_digits(x: Column) -> Column:
    return F.translate(x, ARABIC_DIGITS, "0123456789")


def title_key(x: Column) -> Column:
    """Lower-case letters and digits only, for comparing titles of different origin."""
    return F.regexp_replace(F.lower(normalize_dashes(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))), "[^a-z0-9]", "")


def collapse_space(x: Column) -> Column:
    return strip(F.regexp_replace(x, "(?U)\\s+", " "))


def same_title(a: Column, b: Column) -> Column:
    """Equal keys, or the shorter, if long enough, inside the longer."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= MIN_TITLE_CHARS) & long.contains(short)))


def unspace(x: Column) -> Column:
    """Letter-spaced headings: single letters glued inside chunks that wider gaps part."""

    def spaced(tokens: Column) -> Column:
        single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
        return (F.size(tokens) >= 4) & (single >= F.size(tokens) * 0.6)

    tokens = F.filter(F.split(x, "(?U)\\s+"), lambda t: t != "")
    glued = F.transform(F.split(strip(x), "(?U)\\s{2,}"), lambda c: F.regexp_replace(c, "(?U)\\s+", ""))
    return F.when(let(tokens, spaced), F.array_join(F.filter(glued, lambda c: c != ""), " ")).otherwise(x)


def label_atoms(token: Column) -> Column:
    """Letters, a group in parentheses, digits; or else the runs of letters and of digits."""
    shape = "^([A-Za-z]+)(?:\\(([A-Za-z0-9]+)\\))?(\\d+)?$"
    parts = F.filter(F.array(*[F.regexp_extract(token, shape, k) for k in (1, 2, 3)]), lambda p: p != "")
    return F.when(token.rlike(shape), parts).otherwise(F.regexp_extract_all(token, F.lit("[A-Za-z]+|\\d+"), F.lit(0)))


def label_head(title: Column) -> Column:
    """The token that may be a numbering label, behind a structural word."""

    def rest(t: Column) -> Column:
        word, arabic = F.regexp_extract(t, LABEL_WORDS, 0), F.regexp_extract(t, ARABIC_LABEL_WORDS, 0)
        return (
            F.when(word != "", F.regexp_replace(F.substr(t, F.length(word) + 1), "^[ \\-]+", ""))
            .when(arabic != "", F.regexp_replace(F.substr(t, F.length(arabic) + 1), "^[ \\-:()]+", ""))
            .otherwise(t)
        )

    head = F.regexp_extract(western_digits(let(let(strip(title), unspace), rest)), "(?U)^\\s*(\\S+)", 1)
    return F.regexp_replace(F.regexp_replace(head, ":+$", ""), "^[()]+|[()]+$", "")


def label(title: Column) -> Column:
    """Atoms of the numbering label of a title; empty without one."""

    def from_head(head: Column) -> Column:
        pieces = F.transform(F.filter(F.transform(F.split(head, "[.\\-]"), strip), lambda p: p != ""), label_atoms)
        ok = head.rlike("^[A-Za-z0-9]") & (F.length(head) <= MAX_LABEL_CHARS)
        return F.when(ok, let(pieces, from_pieces)).otherwise(NO_ATOMS)

    def from_pieces(pieces: Column) -> Column:
        return F.when(F.forall(pieces, lambda p: F.size(p) > 0), let(F.flatten(pieces), from_atoms)).otherwise(NO_ATOMS)

    def from_atoms(atoms: Column) -> Column:
        return F.when(F.coalesce(F.get(atoms, F.lit(0)).rlike("(?U)^(?:[A-Za-z]|\\d+)$"), F.lit(False)), atoms).otherwise(NO_ATOMS)

    NO_ATOMS = F.array().cast("array<string>")
    return let(label_head(title), from_head)


def numbering_depth(title: Column) -> Column:
    """Depth by the form of the numbering; null without one."""
    dots = lambda x: F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))
    first = lambda t: F.regexp_extract(t, "(?U)^(\\S+)", 1)
    by_form = lambda t: (
        F.when(t.rlike(PART_WORDS), 1)
        .when(t.rlike(ARTICLE_WORDS), 2)
        .when(t.rlike(SECTION_CODE), 2)
        .when(t.rlike(PART_CODE), 1)
        .when(t.rlike(HYPHEN_CLAUSE), F.when(first(t).contains("."), 4).otherwise(3))
        .when(t.rlike(DOTTED_CLAUSE), dots(F.regexp_extract(t, DOTTED_CLAUSE, 1)) + 1)
        .when(t.rlike(PARAGRAPH), dots(F.regexp_extract(t, PARAGRAPH, 1)) + 1)
    )
    return let(strip(title), by_form).cast("int")


def ordinal(digits: Column) -> Column:
    """Dotted number as array<int>, which compares part by part (3.10 after 3.9)."""
    return F.transform(F.split(F.translate(western_digits(digits), "٫", "."), "\\."), lambda x: x.cast("int"))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def ocr_languages(sample: Column) -> Column:
    """Languages to read a text sample with, by the share of scripts among its letters."""
    pick = lambda *x: F.array(*map(F.lit, x))
    text = F.coalesce(sample, F.lit(""))

    def by_counts(n: Column) -> Column:
        arabic, latin = n["arabic"], n["latin"]
        letters = F.greatest(arabic + latin, F.lit(1))
        share, other = arabic / letters, latin / letters
        return (
            F.when((strip(text) == "") | (arabic + latin == 0), pick("deu", "eng"))
            .when((share >= 0.15) & (other >= 0.10), pick("ara", "eng"))
            .when(share >= 0.15, pick("ara"))
            .when(share >= 0.03, pick("ara", "eng"))
            .when(text.rlike(GERMAN), pick("deu", "eng"))
            .otherwise(pick("eng"))
        )

    return let(F.struct(count(text, ARABIC).alias("arabic"), count(text, LATIN).alias("latin")), by_counts)


def supported_languages(wanted: Column, available: Column, fallback: tuple[str, ...] = ("deu", "eng")) -> Column:
    own = F.filter(wanted, lambda x: F.array_contains(available, x))
    return F.when(F.size(own) > 0, own).otherwise(F.array(*map(F.lit, fallback)))


def frontmatter(text: Column, n_ordinals: Column) -> Column:
    """Contents pages and bibliographies: leaders, hardly an ordinal, and a long Latin run."""
    per_1k = F.length(text) / 1000
    return (
        (F.length(text) > 0)
        & (count(text, "[.․…]{4,}") / F.greatest(per_1k, F.lit(1e-9)) >= 1.0)
        & (n_ordinals / F.greatest(per_1k, F.lit(1e-9)) < 0.1)
        & text.rlike("[A-Za-z]{20,}")
    )


# -- tables -----------------------------------------------------------------------------------------
def pipe_cells(line: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(line), "^\\|", ""), "\\|$", "")
    return F.transform(F.split(s, "\\|", -1), strip)


def is_pipe_row(line: Column) -> Column:
    return line.contains("|") & (strip(line) != "")


def is_separator_row(line: Column) -> Column:
    return line.contains("|") & F.forall(pipe_cells(line), lambda c: c.rlike("^[-: ]+$") & c.contains("-"))


def is_number_cell(cell: Column) -> Column:
    return strip(cell).rlike(NUMERIC_CELL)


def row_record(headers: Column, row: Column) -> Column:
    pair = lambda v, i: F.concat(F.coalesce(F.get(headers, i), F.concat(F.lit("col"), (i + 1).cast("string"))), F.lit(": "), v)
    return F.array_join(F.transform(row, pair), "; ")


def row_records(headers: Column, rows: Column) -> Column:
    """rows: the matrix whose first row repeats the headers."""
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: row_record(headers, r))


def table_is_rtl(headers: Column, rows: Column) -> Column:
    text = F.concat(F.array_join(headers, ""), F.array_join(F.flatten(rows), ""))
    solid = F.regexp_replace(text, "(?U)\\s", "")
    return (F.length(solid) > 0) & (count(solid, ARABIC) / F.greatest(F.length(solid), F.lit(1)) > 0.3)


# -- names, model output -------------------------------------------------------------------------------
def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), "[^.](\\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "(?<=[^.])\\.[^.]+$", "")


def without_fences(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(x), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))


def model_ids(answer: Column, field: str) -> Column:
    """Ids in a model's JSON answer; null where it can't be read."""
    return F.get_json_object(without_fences(answer), f"$.{field}").try_cast("string").alias("ids")


def clamp_level(x: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), x))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def mask(value: Column, kind: DataType, sentinel: str = "masked") -> Column:
    """Every string inside a value of this type replaced, at any depth; numbers, truth values and nulls
    stay, and so do the names of fields and keys."""
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.lit(sentinel))
    if isinstance(kind, StructType):
        inner = F.struct(*[mask(value[f.name], f.dataType, sentinel).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: mask(x, kind.elementType, sentinel))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: mask(x, kind.valueType, sentinel))
    return value
