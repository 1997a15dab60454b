"""Substring dedup over bytes by suffix arrays from external induced sorting.

Suffixes must meet in a shard whenever they share WIDTH bytes. Each stretch of WIDTH bytes is dealt
by its anchor, the least (hashed) GRAM-byte string in it, leftmost on ties, which depends on its bytes alone;
stretches with one anchor are sent as one snippet. Spark counts anchors over all texts first, so only
texts around an anchor that recurs send snippets at all.

A shard trims the snippets of an anchor to stretches whose first and last GRAM bytes are found twice
among them, sorts the suffixes of what is left by external induced sorting (see induced) and cuts the
sorted suffixes where their common prefix falls below WIDTH: the stretches of a class are equal, and
all but the earliest go. Snippets that equal an earlier one, and anchors of one snippet only, have
nothing to be sorted against.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import LIMIT, suffix_array
from .packed import ENTRIES, SYMBOL_MASK, Out, deal_bytes, find_repeats, splitmix, unpack_bytes
from .substring import BASE, INVERSE, flag, powers

WIDTH = 100
GRAM = 40
#: Bytes of a shard's snippets that are sorted as one text.
SHARD_BYTES = 1 << 21


class Anchors:
    """Anchors of the stretches of texts one after another: symbol, and the first and last stretch."""

    def __init__(self, texts: list[bytes], width: int, gram: int) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.data = b"".join(texts)
        self.begin = ends - sizes
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.sym, self.first, self.last, self.doc = none.astype(np.uint64), none, none, none
        if n < width:
            return
        raw = np.frombuffer(self.data, np.uint8)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS.to(n), out=sums[1:])
        hashed = splitmix((sums[gram:] - sums[:-gram]) * INVERSES.to(n + 1 - gram))
        # Hash above, place below: the least is the leftmost of the least hash.
        low = (hashed & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashed), dtype=np.uint64)
        span, have = width - gram + 1, 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if span > have:
            low = np.minimum(low[: -(span - have)], low[span - have :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1 - width, bool)
        for b, s in zip(self.begin.tolist(), sizes.tolist(), strict=True):
            if s >= width:
                inside[b : b + s + 1 - width] = True
        starts = np.nonzero(inside)[0]
        if not len(starts):
            return
        at = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = at[1:] != at[:-1]
        head = np.nonzero(new)[0]
        self.first, self.last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
        self.sym = hashed[at[head]] & SYMBOL_MASK
        self.doc = np.searchsorted(ends, self.first, side="right")


class Powers:
    """Powers of a base modulo 2**64, kept as far as they were asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.known = base, powers(1 << 12, base)

    def to(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = powers(max(n, 2 * len(self.known)), self.base)
        return self.known[:n]


POWERS, INVERSES = Powers(BASE), Powers(INVERSE)


def repeated_in_shard(snippets: list[bytes], order: list[int], width: int, limit: int = LIMIT) -> list[np.ndarray]:
    """For each snippet, the starts of its stretches of `width` bytes that equal one of a snippet
    earlier in `order` (rank of each snippet), or an earlier one of its own."""
    # Two bytes a symbol, so that the end of each snippet can be one of its own, below all others.
    sizes = np.array([len(s) + 1 for s in snippets], np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.uint16)
    for b, s in zip(begin.tolist(), snippets, strict=True):
        text[b : b + len(s)] = np.frombuffer(s, np.uint8)
        text[b : b + len(s)] += 1
    places, prefixes = suffix_array(text.tolist(), limit)
    at, common = np.frombuffer(places, np.int64), np.frombuffer(prefixes, np.int64)
    who = np.searchsorted(begin, at, side="right") - 1
    start = at - begin[who]
    # A common prefix counts up to the end of its snippet: the suffix must have `width` bytes of it.
    fits = start + width < sizes[who]
    group = np.cumsum(common < width)
    group, who, start = group[fits], who[fits], start[fits]
    rank = np.asarray(order, np.int64)[who]
    by = np.lexsort((start, rank, group))
    group, who, start = group[by], who[by], start[by]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    out_who, out_start = who[later], start[later]
    by = np.lexsort((out_start, out_who))
    out_who, out_start = out_who[by], out_start[by]
    cuts = np.searchsorted(out_who, np.arange(len(snippets) + 1))
    return [out_start[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


Snippet = tuple[int, int, bytes]


def in_groups(groups: list[list[Snippet]], most: int) -> Iterator[list[list[Snippet]]]:
    """Whole groups together, as many as have about `most` bytes."""
    now, size = [], 0
    for g in groups:
        now.append(g)
        size += sum(len(x[2]) for x in g)
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def trim(groups: list[list[Snippet]], width: int, gram: int) -> list[Snippet]:
    """The parts of snippets whose stretches begin and end with a gram that is found twice in their group."""
    items = [x for g in groups for x in g]
    sizes = np.array([len(x[2]) for x in items], np.int64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    raw = np.frombuffer(b"".join(x[2] for x in items), np.uint8)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS.to(n), out=sums[1:])
    hashed = (sums[gram:] - sums[:-gram]) * INVERSES.to(n + 1 - gram)
    of_group = np.repeat(np.arange(len(groups), dtype=np.uint64), [sum(len(x[2]) for x in g) for g in groups])
    hashed = splitmix(hashed ^ splitmix(of_group[: len(hashed)]))
    inside = np.arange(len(hashed)) + gram <= np.repeat(ends, sizes)[: len(hashed)]
    order = np.argsort(hashed[inside])
    h = hashed[inside][order]
    twice = np.zeros(len(h), bool)
    twice[1:] = h[1:] == h[:-1]
    twice[:-1] |= twice[1:].copy()
    again = np.zeros(len(hashed) + width, bool)
    again[np.nonzero(inside)[0][order[twice]]] = True
    last = width - gram
    ok = again[: n + 1 - width] & again[last : n + 1 - gram] & (np.arange(n + 1 - width) + width <= np.repeat(ends, sizes)[: n + 1 - width])
    at = np.nonzero(ok)[0]
    if not len(at):
        return []
    who = np.searchsorted(ends, at, side="right")
    cut = np.nonzero((np.diff(at) > 1) | (np.diff(who) > 0))[0] + 1
    out = []
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        k, offset, body = items[who[i]]
        a, z = int(at[i] - begin[who[i]]), int(at[j - 1] - begin[who[i]]) + width
        out.append((k, offset + a, body[a:z]))
    return out


def suffix_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay).

    Each byte covered by a stretch of `width` bytes that also starts earlier (in a smaller id or in
    the same text) goes; what stays need not be valid UTF-8. Null texts are empty; texts with fewer
    than `width` bytes stay. See find_repeats for null and repeated ids. An empty table gives an
    empty result. `limit` is the number of suffix tuples that a shard holds in memory.
    """

    def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a = Anchors(texts, width, gram)
        return a.sym, a.doc

    def whole_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [(k, xxhash.xxh3_128_intdigest(t)) for k, t in enumerate(texts) if len(t) >= width]
        return (
            np.array([h & 0xFFFFFFFFFFFFFFFF for _, h in got], np.uint64),
            np.array([h >> 64 for _, h in got], np.uint64),
            np.array([k for k, _ in got], np.int64),
        )

    def candidates_of(texts: list[bytes], ids: np.ndarray, repeated: np.ndarray, out: Out, nb: int) -> np.ndarray:
        a = Anchors(texts, width, gram)
        has = np.zeros(len(texts), bool)
        if not len(repeated) or not len(a.sym):
            return has
        at = np.minimum(np.searchsorted(repeated, a.sym), len(repeated) - 1)
        hit = np.nonzero(repeated[at] == a.sym)[0]
        if not len(hit):
            return has
        has[a.doc[hit]] = True
        own, start = ids[a.doc[hit]], a.first[hit] - a.begin[a.doc[hit]]
        body = [a.data[i : j + width] for i, j in zip(a.first[hit].tolist(), a.last[hit].tolist(), strict=True)]

        def send(*entries) -> None:
            collapse(out, nb, *entries)

        out.gather("snippets", send, a.sym[hit], own, start.astype(np.int64), body, weight=sum(map(len, body)) // 16)
        return has

    def collapse(out: Out, nb: int, sym: np.ndarray, own: np.ndarray, start: np.ndarray, body: list[bytes]) -> None:
        """Of equal snippets of what a task gathered the earliest is sent; the others are repeats."""
        seen: dict[bytes, int] = {}
        keep, later = [], []
        for k in np.lexsort((start, own)).tolist():
            if seen.setdefault(body[k], k) == k:
                keep.append(k)
            elif own[k] != own[f := seen[body[k]]] or start[k] != start[f]:
                later.append(k)
        if later:
            flag(out, nb, own[later], start[later], np.array([len(body[k]) for k in later], np.int64))
        deal_bytes(out, ENTRIES, (sym[keep] % np.uint64(nb)).astype(np.int64), [body[k] for k in keep], sym[keep], own[keep], start[keep])

    def later_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts, sym, own, start = unpack_bytes(bodies, "u8", "i8", "i8")
        d, s, n = [], [], []

        def repeat(k: int, at: int, length: int) -> None:
            d.append(int(own[k]))
            s.append(int(start[k]) + at)
            n.append(length)

        def distinct(items: list[tuple[int, int, bytes]]) -> list[list[tuple[int, int, bytes]]]:
            """items: snippet, offset in it, bytes, earliest first. Those that equal an earlier one are
            repeats; the others come back by anchor, if an anchor has two at least."""
            seen: dict[tuple[int, bytes], int] = {}
            by_anchor: dict[int, list[tuple[int, int, bytes]]] = {}
            for k, at, body in items:
                f = seen.setdefault((int(sym[k]), body), k)
                if f == k:
                    by_anchor.setdefault(int(sym[k]), []).append((k, at, body))
                elif (own[k], start[k]) != (own[f], start[f]):
                    repeat(k, at, len(body))
            return [x for x in by_anchor.values() if len(x) > 1]

        first = distinct([(k, 0, texts[k]) for k in np.lexsort((start, own)).tolist()])
        trimmed = [x for members in in_groups(first, SHARD_BYTES) for x in trim(members, width, gram)]
        trimmed.sort(key=lambda x: (own[x[0]], start[x[0]] + x[1]))
        for groups in in_groups(distinct(trimmed), SHARD_BYTES):
            shard = sorted((x for g in groups for x in g), key=lambda x: (own[x[0]], start[x[0]] + x[1]))
            found = repeated_in_shard([body for *_, body in shard], list(range(len(shard))), width, limit)
            for (k, at, _), starts in zip(shard, found, strict=True):
                if len(starts):
                    for part in np.split(starts, np.nonzero(np.diff(starts) > 1)[0] + 1):
                        repeat(k, at + int(part[0]), int(part[-1] - part[0]) + width)
        return np.array(d, np.int64), np.array(s, np.int64), np.array(n, np.int64)

    def result_of(text: bytes, runs: np.ndarray | None) -> tuple[bytes, int, bytes]:
        if runs is None:
            runs = np.array([[0, len(text)]] if len(text) >= width else np.zeros((0, 2)), np.int64).reshape(-1, 2)
        kept, at, gone = hashlib.sha256(), 0, 0
        for a, z in runs.tolist():
            kept.update(text[at:a])
            at, gone = z, gone + min(z, len(text)) - a
        kept.update(text[at:])
        return b"%d,%d" % (gone, len(runs)), len(text), kept.digest()

    found = find_repeats(docs, id_col, text_col, symbols_of, whole_of, candidates_of, later_of, result_of)
    both = F.split(F.col("body").cast("string"), ",")
    return found.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        both[0].cast("long").alias("n_removed"),
        both[1].cast("long").alias("n_spans"),
        F.lower(F.hex("digest")).alias("kept_sha256"),
    )
