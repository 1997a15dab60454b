"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints within three bits share at least five
of them (the guaranteed minimum). The index posts each fingerprint under 14 keys of four positional
bytes, the sets of positions whose indices XOR to zero: every three positions lie inside one such
set, whose complement is another, so a pair that differs in at most three bytes shares a whole key.
Within a posting list the shared positional bytes of a pair are tallied, pairs with five or more are
retained, and their bits are verified. A list gives a spanning forest of its links, not its pairs.

Lists over LIST_LIMIT are posted again under a fifth byte (of the other four positions one must still
agree). Such a list has only 24 free bits, hence at most 2**24 different fingerprints, and beyond
LIST_LIMIT its candidate pairs are looked up instead of taking all pairs; they are tallied and
verified alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups
from .components import components

SHINGLE_WORDS = 3
SEED = 42
BITS = 3
KEYS = [k for k in combinations(range(8), 4) if k[0] ^ k[1] ^ k[2] ^ k[3] == 0]
MIN_SHARED = 8 - BITS
LIST_LIMIT = 2_048


def fingerprint(text: str, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(line[a:z], seed) for a, z in spans], np.uint64)
    counts, step = np.zeros(64, np.int64), 4_096
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int32)
    over = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.fromiter((fingerprint(t or "") for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray, near) -> np.ndarray:
    """Least index reachable from each index. near(labels): the least label among each one's links."""
    labels = np.arange(len(fps))
    while True:
        new = np.minimum(labels, near(labels))
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def link_list(fps: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each fingerprint (distinct, uint64) of a posting list, the least index it is linked to."""
    n = len(fps)
    if n <= LIST_LIMIT:
        x = fps[:, None] ^ fps[None, :]
        shared = (x.view(np.uint8).reshape(n, n, 8) == 0).sum(2, dtype=np.uint8)
        linked = (shared >= 8 - bits) & (popcount(x) <= bits)
        return _forest(fps, lambda labels: np.where(linked, labels[None, :], n).min(1))
    free = np.bitwise_or.reduce(fps ^ fps[0])
    places = [np.uint64(1) << np.uint64(k) for k in range(64) if int(free) >> k & 1]
    masks = [np.bitwise_or.reduce(np.array(c, np.uint64)) for r in range(1, bits + 1) for c in combinations(places, r)]
    order = np.argsort(fps)
    ordered = fps[order]

    # The candidates of each mask are tallied and verified like any pair: that they are there is looked up.
    found = []
    for m in masks:
        want = fps ^ m
        at = np.minimum(np.searchsorted(ordered, want), n - 1)
        a = np.nonzero(ordered[at] == want)[0]
        b = order[at[a]]
        x = fps[a] ^ fps[b]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        linked = (shared >= 8 - bits) & (popcount(x) <= bits)
        found.append(np.stack([a[linked], b[linked]]))
    a, b = np.concatenate(found, axis=1)

    def near(labels: np.ndarray) -> np.ndarray:
        best = labels.copy()
        np.minimum.at(best, a, labels[b])
        return best

    return _forest(fps, near)


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = [], []
        column = b.column(0)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            fps = values[i:j]
            root = link_list(fps)
            child = np.nonzero(root != np.arange(len(fps)))[0]
            a.append(fps[child])
            z.append(fps[root[child]])
        flat = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([flat(a), flat(z)], ["a", "b"])


def _key(positions: tuple[int, ...], k: int) -> Column:
    """The bytes of fp at these positions, and the number of the set, as one value."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v"))


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp (long, distinct). Edges a, b that connect all fingerprints within BITS bits."""
    coarse = distinct.select("fp", F.posexplode(F.array(*[_key(p, k) for k, p in enumerate(KEYS)])).alias("set", "key"))
    coarse = coarse.select("key", "set", "fp")
    sizes = coarse.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark takes the exploded keys for as small as the fingerprints they come from: never by broadcast.
    sized = coarse.hint("merge").join(sizes.hint("merge"), "key")
    lists = sized.filter(F.col("n") <= LIST_LIMIT).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    large = sized.filter(F.col("n") > LIST_LIMIT)
    finer = [
        F.when(F.col("set") == k, F.array(*[_key((*p, q), 64 + 8 * k + q) for q in range(8) if q not in p])) for k, p in enumerate(KEYS)
    ]
    fine = large.select("fp", F.explode(F.coalesce(*finer)).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    both = lists.select("fps").union(fine.filter(F.size("fps") > 1).select("fps"))
    return both.mapInArrow(_link_lists, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id of all
    that can be reached over links).

    A null text is empty; texts without words have fingerprint 0 and are linked like others. Equal
    fingerprints are one node, so copies cost nothing in the index. Null ids count as larger than all
    others: a component of null ids only has a null component_id. Extra columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(_fingerprints, "doc_id long, fp long"))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    by_node = join_groups(placed.select("fp", "n", "root"), least, "root", "members", nodes.count(), F.col("fp").cast("string"))
    out = join_groups(rows, by_node.select("fp", "n", "component_id"), "fp", "n", rows.count(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
