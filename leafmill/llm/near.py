"""Near copies by SimHash and by MinHash, verified by the Jaccard similarity of word shingles.

The index of simhash.py finds the texts whose fingerprints are within its three bits: positional bytes,
count filter, bits. A text goes with the texts it is linked to there, in blocks of BLOCK, and what the
shingle sets verify is an edge.

At the similarity asked for, most pairs differ in more bits than that index can be asked for. MinHash
bands find those too: BANDS keys of ROWS least hashes each, so a pair of similarity 0.8 misses
all of them with a chance of 3 in a million, a more similar one with less. Candidates are verified by
the shingle sets themselves, and every pair of a list that isn't connected already is verified:

1. Each text goes to its largest list only, in blocks of BLOCK, and is linked inside its block; the
   first text of what is linked there is its label.
2. Of a list, the texts that are labels go on, in blocks again, until none has more than a block of
   labels; linked labels are merged. So a group of copies shrinks by a factor of BLOCK a round, and its
   members are sent once, however many lists they share.
3. What is left are lists in which labels meet that may still be linked by other members. There the
   members of the commonest label go to one block each, all others to every block; if the others are
   too many for that, every two blocks of the list meet.

Equal labels are connected; that connected texts have one label isn't needed, for the components are
taken over all links in the end.

Keys with the same documents are one list.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, first_row, in_bitmap, join_groups, text_or_empty
from .components import components
from .packed import splitmix
from .simhash import fingerprint, links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
LIST_LIMIT, BLOCK = 1_024, 512
BATCH_BYTES = 1 << 24
#: Rounds of step 2 at most; each divides the components of a list by up to BLOCK.
MOST_ROUNDS = 6
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS, _TERMS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the different word shingles of a text, in order; a short text is one, an empty one has none."""
    words = text.encode().lower().split()  # as in simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:z]) for a, z in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a shingle set; none for an empty set."""
    if not len(own):
        return own
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1_024):
        least = np.minimum(least, (own[i : i + 1_024, None] * _FACTORS + _TERMS).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = splitmix(key * _MIX + column)
    return key


def link_sets(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each shingle set, the index of one that reaches it over pairs of this similarity or more (the
    first of its component). A set is compared with those that no other has reached yet."""
    least = Fraction(str(similarity))
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    open_ = np.ones(len(sets), bool)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        reached = [first]
        while reached:
            p = reached.pop()
            if 2 * (left := open_[owner]).sum() < len(owner):
                values, owner = values[left], owner[left]
            if not len(owner):
                break
            own = sets[p]
            hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            shared = np.bincount(owner[hit], minlength=len(sets))
            union = sizes + sizes[p] - shared
            new = np.nonzero(open_ & (shared * least.denominator >= union * least.numerator))[0]
            open_[new] = False
            root[new] = first
            reached += new.tolist()
    return root


def near_components(
    docs: DataFrame, width: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, component_id (least doc_id of all that can be reached over pairs
    whose shingle sets have this similarity or more), kept [, row].

    A null text is empty; texts without words are one component. Equal texts are one node, known by 64 bits. Null ids
    count as larger than all others. kept: the id is the component's; with row_col, a key of each row, exactly one row of
    a component is kept. An empty table gives an empty result; further columns are ignored. The bands are laid for
    similarities of 0.8 and more: lower ones are found less surely.
    """
    key = F.lit(0) if row_col is None else F.col(row_col)
    key_type = "int" if row_col is None else docs.schema[row_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(shingles(t, width)) for t in b.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            node = pa.array([0 if not len(k) else n for n, k in zip(b.column(2).to_pylist(), keys, strict=True)], pa.int64())
            fp = pa.array(np.fromiter(map(fingerprint, b.column(3).to_pylist()), np.uint64, b.num_rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, lists, fp], ["doc_id", "row", "node", "keys", "fp"])

    def dealt_rows(group: list[str], nodes: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(group, pa.string()), pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["group", "node", "body"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, nodes, bodies, held = [], [], [], 0
            for node, text, groups in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                body = shingles(text, width).tobytes()
                for g in groups:
                    group.append(g)
                    nodes.append(node)
                    bodies.append(body)
                    held += len(body)
                    if held > BATCH_BYTES:
                        yield dealt_rows(group, nodes, bodies)
                        group, nodes, bodies, held = [], [], [], 0
            yield dealt_rows(group, nodes, bodies)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(nodes: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
            if len(nodes) < 2:
                return [], []
            root = link_sets(sets, similarity).tolist()
            child = [k for k, r in enumerate(root) if k != r]
            return [nodes[k] for k in child], [nodes[root[k]] for k in child]

        def out(a: list[int], z: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

        now, nodes, sets = None, [], []
        for b in batches:
            a, z = [], []
            for group, node, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if group != now:
                    more = edges(nodes, sets)
                    a, z = a + more[0], z + more[1]
                    now, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(np.frombuffer(body, np.uint64))
            yield out(a, z)
        yield out(*edges(nodes, sets))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row"), text_or_empty(text_col).alias("t"))
    texts = texts.select("doc_id", "row", F.xxhash64("t").alias("node"), "t")
    rows = cut(texts.mapInArrow(sketch, f"doc_id long, row {key_type}, node long, keys array<long>, fp long"))
    posts = rows.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    # Keys with the same documents are one list: their number and two hashes of them agree.
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), *marks).filter("n > 1")
    sizes = lists.groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "n")
    total = rows.count() * BANDS
    of_node = F.col("node").cast("string")
    listed = cut(join_groups(posts, sizes, "key", "n", total, of_node).filter("n IS NOT NULL"))
    # The SimHash index: each text and the one it hangs on, over equal fingerprints and over links.
    prints = cut(rows.filter(F.size("keys") > 0).select("fp", "node").distinct())
    firsts = prints.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n"))
    equal = join_groups(prints, firsts, "fp", "n", total, of_node).select("hub", "node")
    child, hub = firsts.select(F.col("fp").alias("a"), F.col("hub").alias("node")), firsts.select(F.col("fp").alias("b"), "hub")
    hung = links(firsts.select("fp")).distinct().join(child, "a").join(hub, "b").select("hub", "node")
    stars = cut(equal.union(hung).filter("hub <> node"))
    members = listed.select("node").union(stars.select("node")).union(stars.select("hub")).distinct()
    bodies = cut(in_bitmap(texts.select("node", "t"), members, "node", members.count()).dropDuplicates(["node"]))

    def linked(wanted: DataFrame) -> DataFrame:
        """wanted: node, group. Edges between texts that meet in a group."""
        by_node = wanted.groupBy("node").agg(F.collect_list("group").alias("groups"))
        dealt = bodies.join(by_node, "node").select("node", "t", "groups").mapInArrow(deal, "group string, node long, body binary")
        return cut(dealt.repartition("group").sortWithinPartitions("group", "node").mapInArrow(link, "a long, b long"))

    def group_of(*parts) -> Column:
        return F.concat_ws(" ", *[p.cast("string") for p in parts]).alias("group")

    def block(n: Column) -> Column:
        return F.pmod(F.xxhash64("node"), F.ceil(n / BLOCK))

    of_hub = stars.groupBy("hub").agg(F.count("*").alias("m"))
    met = join_groups(stars, of_hub, "hub", "m", total, of_node).select("hub", "node", group_of(F.lit("s"), F.col("hub"), block(F.col("m"))))
    by_print = linked(met.select("node", "group").union(met.select("hub", "group").distinct()))

    # 1: the largest list of each text. Each is in one group, so what it is linked to is its label.
    picked = listed.groupBy("node").agg(F.max(F.struct("n", "key")).alias("p")).select("node", "p.key")
    own = picked.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    met = join_groups(picked, own, "key", "m", total, of_node).filter("m IS NOT NULL")
    edges = linked(met.select("node", group_of(F.col("key"), block(F.col("m")))))
    named = picked.select("node").join(edges.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("label"))
    labelled = cut(listed.select("key", "node").join(named, "node"))

    def counted() -> DataFrame:
        """Lists of two labels at least: labels, texts, texts that are labels, texts of the commonest label."""
        by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("texts"), F.sum((F.col("node") == F.col("label")).cast("long")).alias("own"))
        sums = by_label.groupBy("key").agg(F.count("*").alias("c"), F.sum("texts").alias("n"), F.sum("own").alias("own"), F.max(F.struct("texts", "label")).alias("top"))
        return cut(sums.filter("c > 1"))

    # 2: the labels of a list among themselves.
    compared = None
    for _ in range(MOST_ROUNDS):
        still = counted()
        most = still.agg(F.max("c")).first()[0] or 0
        if most < 2:
            break
        labels = labelled.select("key", F.col("label").alias("node")).distinct()
        met = join_groups(labels, still.select("key", "c"), "key", "c", total, of_node).filter("c IS NOT NULL")
        new = linked(met.select("node", group_of(F.col("key"), block(F.col("c")))))
        edges = edges.union(new)
        # A label becomes the least one that it is linked to, and that label's least one in turn.
        hop = new.union(new.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        jump = hop.join(hop.select(F.col("a").alias("m"), F.col("m").alias("further")), "m", "left").select(F.col("a").alias("label"), F.coalesce("further", "m").alias("to"))
        labelled = cut(labelled.join(jump, "label", "left").select("key", "node", F.coalesce("to", "label").alias("label")))
        # Where every text was a label of its own, and all in one block, all pairs have been compared.
        compared = still.filter((F.col("own") == F.col("n")) & (F.col("c") <= BLOCK)).select("key")
        if most <= BLOCK:
            break

    # 3: lists whose labels may be linked by other members.
    if compared is not None:
        rest = counted().join(compared, "key", "left_anti").select("key", "n", "top")
        met = join_groups(labelled, rest, "key", "n", total, of_node).filter("n IS NOT NULL")
        others = F.col("n") - F.col("top.texts")
        blocks, mine = F.ceil(F.col("n") / BLOCK), block(F.col("n"))
        every = F.sequence(F.lit(0).cast("long"), blocks - 1)
        one = F.array(group_of(F.col("key")))
        to_all = F.transform(every, lambda j: group_of(F.col("key"), F.lit("b"), j))
        to_one = F.array(group_of(F.col("key"), F.lit("b"), mine))
        to_pairs = F.transform(every, lambda j: group_of(F.col("key"), F.lit("p"), F.least(mine, j), F.greatest(mine, j)))
        top = F.col("label") == F.col("top.label")
        groups = F.when(F.col("n") <= LIST_LIMIT, one).when(others > LIST_LIMIT, to_pairs).when(top, to_one).otherwise(to_all)
        edges = edges.union(linked(met.select("node", F.explode(groups).alias("group"))))
    roots = components(edges.union(by_print))

    nodes = rows.groupBy("node").agg(first_row("doc_id", "row").alias("first"), F.count("*").alias("n"))
    roots = roots.select(F.col("node").alias("linked"), "root")
    placed = nodes.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("members"))
    by_node = join_groups(placed.select("node", "n", "root"), least, "root", "members", nodes.count(), F.col("node").cast("string"))
    slim = rows.select("doc_id", "row", "node")
    unique = F.concat_ws("~", F.col("doc_id").cast("string"), F.col("row").cast("string"))
    out = join_groups(slim, by_node.select("node", "n", "stays"), "node", "n", rows.count(), unique)
    own = F.lit(True) if row_col is None else F.col("row") == F.col("stays.row")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.id")) & own
    return out.select("doc_id", F.col("stays.id").alias("component_id"), kept.alias("kept"), *([] if row_col is None else [F.col("row").alias(row_col)]))
