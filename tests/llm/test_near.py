"""Near copies of the pipeline against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(docs):
    own, root = {d: sets(t) for d, t in docs}, {}
    for d in sorted(own):
        old = {root[e] for e in root if 5 * len(own[e] & own[d]) >= 4 * len(own[e] | own[d])}
        root[d] = min([d, *old])
        root |= {e: root[d] for e in root if root[e] in old}
    return {d for d in root if root[d] == d}


def near_copies(seed=3):
    r = random.Random(seed)
    docs, n = [], 0
    for changes in range(12):
        base = [f"w{r.randrange(5_000)}" for _ in range(200)]
        docs.append((n, " ".join(base)))
        for k in range(2):
            other = list(base)
            for at in r.sample(range(200), changes):
                other[at] = f"x{n}y{at}"
            docs.append((n + k + 1, " ".join(other)))
        n += 3
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "a", "en", 1) for d, t in docs], "doc_id long, text string, source string, lang string, n_chars int")


def test_near_stage(spark, sf_dir):
    docs = near_copies()
    want = kept(docs)
    got = corpus_pipeline.near_stage(spark, frame(spark, docs), sf_dir).collect()
    assert {r.doc_id for r in got} == want and 15 < len(want) < 30


def test_near_stage_in_blocks(spark, sf_dir, monkeypatch):
    from leafmill.llm import near

    monkeypatch.setattr(near, "LIST_LIMIT", 12)
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "BATCH_BYTES", 4_000)
    monkeypatch.setattr(near, "MOST_ROUNDS", 2)
    base = near_copies()[0][1].split()
    docs = [(k, " ".join([*base[:-1], f"end{k}"])) for k in range(40)] + [(k + 100, t) for k, t in near_copies(4)]
    got = corpus_pipeline.near_stage(spark, frame(spark, docs), sf_dir).collect()
    assert {r.doc_id for r in got} == kept(docs)


def test_link_sets():
    from leafmill.llm.near import link_sets

    a = np.arange(100, dtype=np.uint64)
    # 0-2-1 is a chain: 90 of 110 shared (0.818) next to each other, 80 of 120 at its ends; 3 is just below 0.8.
    assert link_sets([a, a + np.uint64(20), a + np.uint64(10), a[:79]]).tolist() == [0, 0, 0, 3]
    assert link_sets([a, a[:80]]).tolist() == [0, 0]


def test_near_rounds_against_all_pairs(spark, sf_dir, monkeypatch):
    """Small blocks: groups of copies over many blocks, chains between groups, and lists that stay open."""
    from leafmill.llm import near

    monkeypatch.setattr(near, "LIST_LIMIT", 10)
    monkeypatch.setattr(near, "BLOCK", 6)
    monkeypatch.setattr(near, "MOST_ROUNDS", 2)
    r = random.Random(0)
    docs, n = [], 0
    for size in (50, 12, 7, 2):
        base = [f"w{r.randrange(900)}" for _ in range(120)]
        for _ in range(size):
            for at in r.sample(range(120), r.randrange(0, 3)):  # copies of copies drift away from the first
                base = [*base[:at], f"x{r.randrange(9)}", *base[at + 1 :]]
            docs.append((n, " ".join(base)))
            n += 1
    r.shuffle(docs)
    got = corpus_pipeline.near_stage(spark, frame(spark, docs), sf_dir).collect()
    assert {x.doc_id for x in got} == kept(docs)


def test_near_stage_goes_through_the_simhash_index(spark, sf_dir, monkeypatch):
    """Without the bands, the copies within three bits of a fingerprint are still found, and verified."""
    from leafmill.llm import near
    from leafmill.llm.simhash import fingerprint

    monkeypatch.setattr(near, "band_keys", lambda own: np.bitwise_xor.reduce(own, keepdims=True) if len(own) else own)
    monkeypatch.setattr(near, "BLOCK", 8)
    base = [f"w{k}" for k in range(900)]
    docs = [(k, " ".join([*base[:-1], f"end{k}"])) for k in range(30)]  # one shingle of each is its own
    docs += [(100, "same fingerprint of all"), (101, "Same  fingerprint of all"), (102, "a text by itself"), (103, ""), (104, " ")]
    fps = [fingerprint(t) for _, t in docs[:30]]
    assert all((x ^ y).bit_count() <= 3 for x in fps for y in fps[:1])
    got = corpus_pipeline.near_stage(spark, frame(spark, docs), sf_dir).collect()
    assert {r.doc_id for r in got} == {0, 100, 102, 103}
