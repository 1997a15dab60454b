"""Splitting oversized leaves at ordinal headings, byte-exact on the original text.

Only leaves over the limit cross to Python: they are folded (NFKC per character, marks dropped) with a
map back to the original offsets, and the longest increasing run of their ordinals gives the cuts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as an ordinal heading, a paragraph word, and marks without weight.
ORDINAL = re.compile(
    r"§\s*\(?\s*(\d+(?:\.\d+)?)|Art(?:icle|\.)?\s+\(?\s*(\d+(?:\.\d+)?)|Section\s+\(?\s*(\d+(?:\.\d+)?)"
    r"|(?:ال)?مادة\s*\(?\s*([\d٠-٩]+(?:[.٫][\d٠-٩]+)?)"
)
PARAGRAPH = re.compile(r"(?:ال)?فقرة\b")
LEADER = re.compile(r"[.․…]{4,}")
LATIN_RUN = re.compile(r"[A-Za-z]{20,}")
DROPPED = frozenset("ـ​‌‍‎‏‪‫‬‭‮﻿")
MAX_CHARS, MIN_SEGMENTS, MIN_GAP, TITLE_CHARS = 50_000, 3, 5_000, 120


def fold(text: str) -> tuple[str, list[int]]:
    """Folded text, and for each of its characters the place in the original."""
    chars, places = [], []
    for i, c in enumerate(text):
        if c not in DROPPED:
            got = c if c.isascii() else unicodedata.normalize("NFKC", c)
            chars.append(got)
            places += [i] * len(got)
    return "".join(chars), places


def ordinal_of(m: re.Match) -> tuple[int, ...]:
    digits = next((g for g in m.groups() if g), "").replace("٫", ".")
    return tuple(int(p) for p in digits.split("."))


def increasing_run(values: list) -> list[int]:
    """Indices of a longest strictly increasing subsequence; the earliest wins ties, for a predecessor
    and for the end. Piles hold the indices that end a run of one length: a later one on a pile is
    never larger, so both searches are by halves."""
    piles: list[list[int]] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        n = bisect_left(piles, v, key=lambda pile: values[pile[-1]])
        if n:
            below = piles[n - 1]
            before[i] = below[bisect_left(below, True, key=lambda j: values[j] < v)]
        if n == len(piles):
            piles.append([])
        piles[n].append(i)
    out = [piles[-1][0]] if piles else []
    while out and before[out[-1]] >= 0:
        out.append(before[out[-1]])
    return out[::-1]


def greedy_gap(starts: list[int], gap: int) -> list[int]:
    kept: list[int] = []
    for s in starts:
        if not kept or s - kept[-1] >= gap:
            kept.append(s)
    return kept


def greedy_gap_column(starts: Column, gap: int) -> Column:
    """The same as a fold, for arrays of offsets in a plan."""
    empty = F.array().cast("array<int>")
    last = lambda kept: F.get(kept, F.size(kept) - 1)
    return F.aggregate(
        starts.cast("array<int>"),
        empty,
        lambda kept, s: F.when((F.size(kept) == 0) | (s - last(kept) >= gap), F.concat(kept, F.array(s))).otherwise(kept),
    )


def cuts(text: str, max_chars: int, min_segments: int, min_gap: int) -> list[int]:
    """Offsets at which a leaf is split; none if it stays."""
    if len(text) <= max_chars:
        return []
    folded, places = fold(text)
    found = list(ORDINAL.finditer(folded))
    per_1k = len(text) / 1000
    if len(LEADER.findall(text)) / per_1k >= 1.0 and len(found) / per_1k < 0.1 and LATIN_RUN.search(text):
        return []
    if len(found) >= min_segments:
        run = increasing_run([ordinal_of(m) for m in found])
        if len(run) >= min_segments:
            return [places[found[k].start()] for k in run]
    marks = [places[m.start()] for m in PARAGRAPH.finditer(folded)]
    if len(marks) < min_segments:
        return []
    kept = greedy_gap(marks, min_gap)
    ends = [*kept[1:], len(text)]
    return kept if len(kept) >= 2 and all(z - a < max_chars for a, z in zip(kept, ends, strict=True)) else []


def split_leaf(node_id: str, text: str, max_chars: int, min_segments: int, min_gap: int) -> list[tuple[str, str | None, str, int, str]]:
    """(node_id, parent id, title, depth below, text) of a leaf and all that it splits into, in order."""
    out: list[tuple[str, str | None, str, int, str]] = []

    def visit(own: str, parent: str | None, title: str, depth: int, body: str) -> None:
        at = cuts(body, max_chars, min_segments, min_gap)
        out.append((own, parent, title, depth, body[: at[0]] if at else body))
        for k, (a, z) in enumerate(zip(at, [*at[1:], len(body)][: len(at)], strict=True)):
            seg = body[a:z]
            first = seg.splitlines()[0].strip() if seg.splitlines() else seg.strip()
            # A segment that is the whole text again can't be split further.
            if seg == body:
                out.append((f"{own}-s{k}", own, first[:TITLE_CHARS], depth + 1, seg))
            else:
                visit(f"{own}-s{k}", own, first[:TITLE_CHARS], depth + 1, seg)

    visit(node_id, None, "", 0, text)
    return out


def split_oversized(leaves: DataFrame, max_chars: int = MAX_CHARS, min_segments: int = MIN_SEGMENTS, min_gap: int = MIN_GAP) -> DataFrame:
    """leaves: doc_id, node_id, text. All of them, oversized ones split: doc_id, node_id, parent_id,
    seq, depth, title, text. Leaves within the limit stay in the JVM."""
    kind = leaves.schema["doc_id"].dataType.simpleString()
    small = leaves.filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).select(
        "doc_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("seq"), F.lit(0).alias("depth"), F.lit("").alias("title"), "text"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (d, own, parent, seq, depth, title, text)
                for d, node, body in zip(b["doc_id"], b["node_id"], b["text"], strict=True)
                for seq, (own, parent, title, depth, text) in enumerate(split_leaf(node or "x", body, max_chars, min_segments, min_gap))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "node_id", "parent_id", "seq", "depth", "title", "text"])

    large = leaves.filter(F.length("text") > max_chars).select("doc_id", "node_id", "text")
    out = large.mapInPandas(run, f"doc_id {kind}, node_id string, parent_id string, seq int, depth int, title string, text string")
    return small.union(out)


@F.pandas_udf(StringType())  # type: ignore[call-overload]
def folded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else fold(t)[0])
