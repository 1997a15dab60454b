"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary, up a tree.

An element stands for a text and holds its pieces (the matches of the splitting pattern). Two
elements are joined by splitting again a window around the boundary: a match is settled in the left
text if it ends LOOK characters before its end, for the pattern looks no further; the window grows to
the right until a match begins where one begins in the right text, since the splitter has no memory.

Inside a piece, the same again with tokens: halves are encoded, and the window of tokens around the
boundary grows until, on both seams, the two tokens that meet are what their concatenation encodes
to. A sequence of tokens is the encoding of its bytes exactly if each two neighbours are, so what
lies outside the window is settled. Pieces up to LEAF bytes are leaves.

Decoding concatenates the tokens' bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after a match that the pattern may have looked at.
LOOK = 2
#: Bytes of a piece, and characters of a text, that are a leaf of the tree: a word, and some lines.
LEAF, LEAF_TEXT = 16, 512
#: Pieces of so many characters are kept with their tokens.
KNOWN_CHARS = 64
CACHE_ENTRIES = 300_000


class Bpe:
    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        # White space is the Unicode property, as in the splitter that defines the encoding.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    # -- tokens of one piece --------------------------------------------------------------------
    def leaf(self, piece: bytes) -> list[int]:
        if (one := self.ranks.get(piece)) is not None:
            return [one]
        return self.core.encode_single_piece(piece) if piece else []

    def settled(self, a: int, b: int) -> bool:
        return self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            inner = b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j])
            window = self.leaf(inner)
            left_ok = i == len(left) or self.settled(left[-i - 1], window[0])
            right_ok = j == len(right) or self.settled(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    # -- pieces of a text -----------------------------------------------------------------------
    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        keep, loose = len(left), 0
        while keep and loose < LOOK:
            keep -= 1
            loose += len(left[keep])
        # The match before must end LOOK before the end; those after it are split again.
        tail, n = "".join(left[keep:]), 4
        while True:
            n = min(n, len(right))
            window = self.find(tail + "".join(right[:n]))
            size = sum(map(len, window))
            starts, at = {}, len(tail)
            for k, p in enumerate(right[:n]):
                starts[at] = k
                at += len(p)
            at = 0
            for k, p in enumerate(window):
                if at in starts:
                    return left[:keep] + window[:k] + right[starts[at] :]
                if n < len(right) and at + len(p) + LOOK > size:
                    break
                at += len(p)
            else:
                return left[:keep] + window + right[n:]
            n *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_TEXT:
            return self.find(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> list[int]:
        seen, out = self.seen, []
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        for p in self.pieces(text):
            if (ids := seen.get(p)) is None:
                ids = self.tokens(p.encode())
                if len(p) <= KNOWN_CHARS:
                    seen[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TEXT // 4:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@cache
def load(rank_file: str, pattern: str) -> Bpe:
    return Bpe(rank_file, pattern)


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256. See bpe_encode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int). A null text is empty and has no ids; special
    tokens are ordinary text; texts of any length are encoded whole. Extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """encoded: doc_id, ids. One row per input row: doc_id, decoded (binary); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
