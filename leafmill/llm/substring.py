"""Substring dedup over words by recompression.

Rounds name what stands next to each other: a run of one symbol becomes a symbol of its own, then
each symbol flips a coin of its name and every left-coin followed by a right-coin becomes a pair
symbol. Names are hashes of what they stand for, so all texts name alike without an exchange, and
equal stretches get equal symbols inside, whatever surrounds them.

A block knows its context: the words that decide that it is a block. A window of WIDTH words that
holds the context holds the block, wherever it occurs. So a window can only recur if all blocks whose
context it holds do; the symbols of those blocks are what Spark counts over all texts. A window that
holds no block is a symbol by itself. Windows that pass are verified by 96-bit names of their words,
built from 128-bit word names.
The highest symbol of a text is the whole text: of equal texts all but the earliest are done there.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import ENTRIES, FLAGS, SYMBOL_MASK, Out, find_repeats, splitmix, unpack_all

WIDTH = 20
ROUNDS = 4
#: Blocks don't grow beyond so many words: a window must hold some.
MAX_BLOCK = 8
KNOWN_WORDS = 100_000
#: Odd, for polynomials modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Words(dict):
    """Word to index; the 128-bit names of the words by index."""

    def __init__(self) -> None:
        super().__init__()
        self.a, self.z = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_128_intdigest(word)
        self.a.append(name & 0xFFFFFFFFFFFFFFFF)
        self.z.append(name >> 64)
        self[word] = k = len(self.a) - 1
        return k

    def names(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.a, self.z = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return np.frombuffer(self.a, np.uint64)[at], np.frombuffer(self.z, np.uint64)[at]


WORDS = Words()


def blocks(names: np.ndarray, head: np.ndarray, rounds: int = ROUNDS, most: int = MAX_BLOCK) -> tuple[np.ndarray, ...]:
    """names: a symbol per word of texts one after another; head: whether a word begins a text.
    Returns symbol, start, end, and context (lo, hi) of the blocks after all rounds. A context that
    reaches over the end of a text is one that no window holds."""
    n = len(names)
    sym, start, end = names, np.arange(n), np.arange(1, n + 1)
    lo, hi = start, end
    edge = np.append(head, True)  # of word positions 0..n: a text begins (or all ends) there
    differs = np.ones(n + 1, bool)  # words before and at a position differ, or a text begins there
    differs[1:n] = (names[1:] != names[:-1]) | head[1:]
    for r in range(rounds):
        # Runs of one symbol.
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | edge[start[1:]]
        at = np.nonzero(new)[0]
        if len(at) < len(sym):
            last = np.append(at[1:], len(sym)) - 1
            count = (last - at + 1).astype(np.uint64)
            sym = np.where(count > 1, splitmix(sym[at] ^ (count * np.uint64(0xD6E8FEB86659FD93))), sym[at])
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            start, end = start[at], end[last]
        # That a run ends where it ends is seen from the next word, or if that is the same, from the next block.
        lo2, hi2 = np.minimum(lo, start - 1), np.maximum(hi, end + 1)
        same = np.nonzero(~differs[start])[0]
        lo2[same] = np.minimum(lo2[same], lo[same - 1])
        hi2[same] = np.maximum(hi2[same], hi[same - 1])
        same = np.nonzero(~differs[end])[0]
        hi2[same] = np.maximum(hi2[same], hi[same + 1])
        lo2[same] = np.minimum(lo2[same], lo[same + 1])
        lo, hi = lo2, hi2
        # Pairs.
        m = len(sym)
        coin = (splitmix(sym + np.uint64(0xA0761D6478BD642F * (r + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        inner = ~edge[end[:-1]] if m else np.zeros(0, bool)
        fits = (end[1:] - start[:-1] <= most) if m else inner
        pair = np.zeros(m, bool)  # with the next one
        pair[:-1] = coin[:-1] & ~coin[1:] & inner & fits
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        first = np.nonzero(pair)[0]
        # What doesn't pair depends on the neighbour that its coin looks to; at the end of a text, on what isn't there.
        alone = ~pair & ~second
        right = np.nonzero(alone & coin)[0]
        left = np.nonzero(alone & ~coin)[0]
        lo2, hi2 = lo.copy(), hi.copy()
        closed = edge[end[right]]
        inside = right[~closed]
        hi2[right[closed]] = np.maximum(hi[right[closed]], end[right[closed]] + 1)
        hi2[inside], lo2[inside] = np.maximum(hi[inside], hi[inside + 1]), np.minimum(lo[inside], lo[inside + 1])
        closed = edge[start[left]]
        inside = left[~closed]
        lo2[left[closed]] = np.minimum(lo[left[closed]], start[left[closed]] - 1)
        hi2[inside], lo2[inside] = np.maximum(hi2[inside], hi[inside - 1]), np.minimum(lo2[inside], lo[inside - 1])
        lo2[first], hi2[first] = np.minimum(lo[first], lo[first + 1]), np.maximum(hi[first], hi[first + 1])
        sym, end = sym.copy(), end.copy()
        sym[first] = splitmix(sym[first] * np.uint64(3) + splitmix(sym[first + 1]))
        end[first] = end[first + 1]
        keep = ~second
        sym, start, end, lo, hi = sym[keep], start[keep], end[keep], lo2[keep], hi2[keep]
    return sym, start, end, lo, hi


class Parsed:
    """Texts one after another as words, names and blocks whose context a window can hold."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        split = [t.split() for t in texts]  # bytes: ASCII white space only
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.a, self.z = WORDS.names([w for own in split for w in own])
        ends = np.cumsum(self.sizes)
        self.begin = ends - self.sizes
        head = np.zeros(len(self.a), bool)
        head[self.begin[self.sizes > 0]] = True
        sym, start, _, lo, hi = blocks(splitmix(self.a), head)
        ok = hi - lo <= width
        self.sym, self.lo, self.hi = sym[ok], lo[ok], hi[ok]
        self.doc = np.searchsorted(ends, start[ok], side="right")
        self.doc_of_word = np.repeat(np.arange(len(texts)), self.sizes)
        # The context must lie in the text.
        ok = (self.lo >= self.begin[self.doc]) & (self.hi <= ends[self.doc])
        self.sym, self.lo, self.hi, self.doc = self.sym[ok], self.lo[ok], self.hi[ok], self.doc[ok]
        n = len(self.a)
        self.starts = np.zeros(0, np.int64)
        if n >= width:
            starts = np.arange(n + 1 - width)
            self.starts = starts[starts + width <= ends[self.doc_of_word[: n + 1 - width]]]
            self.name_a, self.name_z = window_names(self.a, width), window_names(self.z, width)
            bare = self.starts[~self.holds(np.ones(len(self.sym), bool), width)[self.starts]]
            self.sym = np.concatenate([self.sym, splitmix(self.name_a[bare])])
            self.lo, self.hi = np.concatenate([self.lo, bare]), np.concatenate([self.hi, bare + width])
            self.doc = np.concatenate([self.doc, self.doc_of_word[bare]])
        self.sym = self.sym & SYMBOL_MASK

    def holds(self, which: np.ndarray, width: int) -> np.ndarray:
        """For each window start, whether the window holds one of these blocks."""
        n = len(self.a)
        begin = np.bincount(np.maximum(self.hi[which] - width, 0), minlength=n + 2)
        end = np.bincount(self.lo[which] + 1, minlength=n + 2)
        return (np.cumsum(begin - end) > 0)[: n + 1 - width]


def powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    """A name for each stretch of `width` symbols, modulo 2**64."""
    n = len(names)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(splitmix(names) * powers(n, BASE)[:n], out=sums[1:])
    return splitmix((sums[width:] - sums[:-width]) * powers(n, INVERSE)[: n + 1 - width])


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the words that stay).

    Each word covered by a window of `width` words that also starts earlier (in a smaller id or in
    the same text) goes. Null and empty texts have no words; texts with fewer than `width` words stay.
    See find_repeats for null and repeated ids. An empty table gives an empty result.
    """

    def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = Parsed(texts, width)
        return p.sym, p.doc

    def whole_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [(k, xxhash.xxh3_128_intdigest(b" ".join(w))) for k, t in enumerate(texts) if len(w := t.split()) >= width]
        return (
            np.array([h & 0xFFFFFFFFFFFFFFFF for _, h in got], np.uint64),
            np.array([h >> 64 for _, h in got], np.uint64),
            np.array([k for k, _ in got], np.int64),
        )

    def candidates_of(texts: list[bytes], ids: np.ndarray, repeated: np.ndarray, out: Out, nb: int) -> np.ndarray:
        p = Parsed(texts, width)
        has = np.zeros(len(texts), bool)
        if not len(p.starts):
            return has
        at = np.minimum(np.searchsorted(repeated, p.sym), max(0, len(repeated) - 1))
        unique = repeated[at] != p.sym if len(repeated) else np.ones(len(p.sym), bool)
        s = p.starts[~p.holds(unique, width)[p.starts]]
        if not len(s):
            return has
        a, z, doc = p.name_a[s], (p.name_z[s] >> np.uint64(32)).astype(np.uint32), p.doc_of_word[s]
        has[doc] = True

        def send(*entries: np.ndarray) -> None:
            collapse(out, nb, *entries)

        out.gather("windows", send, a, z, ids[doc], (s - p.begin[doc]).astype(np.uint32))
        return has

    def collapse(out: Out, nb: int, a: np.ndarray, z: np.ndarray, own: np.ndarray, start: np.ndarray) -> None:
        """Of equal windows of what a task gathered the earliest is sent; the others are repeats."""
        order = np.lexsort((start, own, z, a))
        a, z, own, start = a[order], z[order], own[order], start[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        later = (own != own[first]) | (start != start[first])
        flag(out, nb, own[later], start[later].astype(np.int64), np.full(later.sum(), width))
        sent = np.nonzero(new)[0][np.lexsort((start[new], own[new]))]
        out.deal(ENTRIES, a[sent] % np.uint64(nb), a[sent], z[sent], own[sent], start[sent])

    def later_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, z, own, start = unpack_all(bodies, "u8", "u4", "i8", "u4")
        order = np.lexsort((start, own, z, a))
        a, z, own, start = a[order], z[order], own[order], start[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        later = (own != own[first]) | (start != start[first])
        return own[later], start[later], np.full(later.sum(), width)

    def result_of(text: bytes, runs: np.ndarray | None) -> tuple[bytes, int, bytes]:
        words = text.split()
        if runs is None:
            kept: list[bytes] = [] if len(words) >= width else words
        elif len(runs):
            kept, at = [], 0
            for a, z in runs.tolist():
                kept += words[at:a]
                at = z
            kept += words[at:]
        else:
            kept = words
        return b"%d" % (len(words) - len(kept)), len(words), hashlib.sha256(b" ".join(kept)).digest()

    found = find_repeats(docs, id_col, text_col, symbols_of, whole_of, candidates_of, later_of, result_of)
    return found.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.col("body").cast("string").cast("long").alias("n_removed"),
        F.lower(F.hex("digest")).alias("kept_sha256"),
    )


def flag(out: Out, nb: int, own: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Tell document buckets of repeated stretches, touching ones of a text as one."""
    if not len(own):
        return
    order = np.lexsort((start, own))
    own, start, end = own[order], start[order], (start + length)[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] > end[:-1])
    at = np.nonzero(new)[0]
    stop = np.maximum.reduceat(end, at)
    out.deal(FLAGS, np.mod(own[at], nb), own[at], start[at], stop - start[at])
