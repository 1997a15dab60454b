"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns,
against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries as Q
from leafmill.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from leafmill.llm.chat import chat_windows, read_windows
from leafmill.llm.exact_dedup import exact_dedup
from leafmill.llm.mixing import mix
from leafmill.llm.quality import keep_clean, quality_rules
from leafmill.llm.sharding import draw_matrix, shard_rows
from leafmill.llm.simhash import fingerprint, simhash_components
from leafmill.llm.substring import substring_dedup
from leafmill.llm.suffix import suffix_dedup
from leafmill.llm.toxicity import segments, toxicity

#: Columns that operators use inside, as further columns of a table.
CLASHES = ("h", "t", "body", "bucket", "kind", "shard", "slot", "size", "key", "fp", "node", "w", "lines", "score", "row", "at", "n")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choices(words, k=45))
    out = []
    for k in range(120):
        own = " ".join(rng.choices(words, k=rng.randint(0, 90)))
        if k % 5 == 0:
            own = f"{own} {passage} {' '.join(rng.choices(words, k=5))}"
        if k % 7 == 0 and k:
            own = out[k - 7][1]
        out.append((k, own, f"s{k % 4}"))
    out += [(200, None, None), (201, "", "s0"), (202, " \n\t ", None), (203, "", "s0"), (None, "null id text", "s1"), (None, None, "s1")]
    out += [(204, "one two", "s1"), (204, "one two", "s1"), (205, "a " * 30_000, "s2"), (206, "aaaa" * 5_000, "s2"), (207, "ü😀 " * 50, "s3")]
    return out


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        exact_dedup(none), quality_rules(none), keep_clean(none), mix(none), shard_rows(none), simhash_components(none), substring_dedup(none),
        suffix_dedup(none), toxicity(none, labels), read_windows(chat_windows(turns)), bpe_of(none),
    ):
        assert df.count() == 0


def bpe_of(df):
    import public_tokenizers as P

    return bpe_digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, corpus, keep, weak):
    hash_fn = {} if not weak else {"hash_fn": lambda t: F.unhex(F.hex(F.length(t) % 3))}  # different texts collide
    got = exact_dedup(table(spark, corpus), keep=keep, **hash_fn).collect()
    assert len(got) == len(corpus)
    groups = {}
    for d, t, _ in corpus:
        groups.setdefault(t or "", []).append(d)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = [i for i in by_sha[r.text_sha256] if i is not None]
        best = (min if keep == "smallest" else max)(ids, default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(by_sha[r.text_sha256]), r.doc_id == best)


def test_exact_dedup_hot_group(spark):
    rows = [(k, "copy" if k % 3 else f"own {k}", "s") for k in range(3_600)]
    got = exact_dedup(table(spark, rows)).collect()
    assert Counter(r.group_size for r in got) == {2_400: 2_400, 1: 1_200}
    assert {r.keep_id for r in got if r.group_size > 1} == {1}


def test_sharding(spark, corpus):
    first = shard_rows(table(spark, corpus), shards=8, rows_per_partition=20)
    got = first.collect()
    assert sorted(got, key=str) == sorted(shard_rows(table(spark, corpus), shards=8, rows_per_partition=20).collect(), key=str)
    # Sizes and checksums by definition, and nothing lost: rows are matched one by one.
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t, _ in corpus)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(corpus) and set(by) <= set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_matrix():
    sizes = [5, 0, 17, 1, 40]
    totals = [0] * 4
    for seed in range(2_000):
        m = draw_matrix(sizes, 4, seed)
        assert [sum(r) for r in m] == sizes
        assert sorted(map(sum, zip(*m, strict=True))) == [15, 16, 16, 16]
        totals[0] += m[0][0]
    # A row's mean share of a shard is the shard's share of all rows.
    assert abs(totals[0] / 2_000 - 5 * 16 / 63) < 0.08


def brute_windows(parts, width):
    """(earlier) flags for each window of each sequence: parts is [(id, sequence)]."""
    first = {}
    for d, x in sorted(parts, key=lambda p: (p[0] is not None, p[0] or 0)):
        for s in range(len(x) - width + 1):
            first.setdefault(tuple(x[s : s + width]), (d, s))
    covered = []
    for d, x in parts:
        gone = [False] * len(x)
        for s in range(len(x) - width + 1):
            if first[tuple(x[s : s + width])] != (d, s):
                gone[s : s + width] = [True] * width
        covered.append(gone)
    return covered


def test_substring_dedup(spark, corpus):
    got = Counter(tuple(r) for r in substring_dedup(table(spark, corpus)).collect())
    parts = [(d, (t or "").encode().split()) for d, t, _ in corpus]
    want = Counter()
    for (d, x), gone in zip(parts, brute_windows(parts, 20), strict=True):
        kept = [w for w, g in zip(x, gone, strict=True) if not g]
        want[(d, len(x), len(x) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert got == want
    assert sum(k[2] for k in got) > 0


@pytest.mark.parametrize("limit", [200, 4_000_000])
def test_suffix_dedup(spark, corpus, limit):
    got = Counter(tuple(r) for r in suffix_dedup(table(spark, corpus), limit=limit).collect())
    parts = [(d, (t or "").encode()) for d, t, _ in corpus]
    want = Counter()
    for (d, x), gone in zip(parts, brute_windows(parts, 100), strict=True):
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[(d, len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


def test_suffix_array_against_sorting():
    from leafmill.llm.induced import suffix_array

    rng = random.Random(0)
    for _ in range(1_500):
        k = rng.choice([1, 2, 3, 200, 3_000_000])
        t = [rng.randint(0, k - 1) for _ in range(rng.randint(0, 50))]
        t = t[: len(t) // 3 + 1] * 3 if rng.random() < 0.5 and t else t
        places, prefixes = suffix_array(t, rng.choice([3, 10, 10**6]))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        common = [0] * len(t)
        for r in range(1, len(t)):
            a, z = want[r - 1], want[r]
            while max(a, z) + common[r] < len(t) and t[a + common[r]] == t[z + common[r]]:
                common[r] += 1
        assert (list(places), list(prefixes)) == (want, common)


def test_simhash(spark, corpus):
    rows = corpus + [(300 + k, corpus[5][1] + " x" * k, "s") for k in range(4)]
    got = simhash_components(table(spark, rows)).collect()
    fps = [(d, fingerprint(t or "")) for d, t, _ in rows]
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", least.get(find(f))) for d, f in fps)


def test_simhash_dense_list(spark):
    import numpy as np

    from leafmill.llm import simhash

    rng = np.random.default_rng(1)
    base = np.uint64(0x1234567890ABCDEF)
    flips = rng.integers(0, 1 << 14, 900).astype(np.uint64) << np.uint64(8)
    fps = np.unique(np.concatenate([base ^ flips, rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    small = simhash.link_list(fps)
    limit, simhash.LIST_LIMIT = simhash.LIST_LIMIT, 10
    try:
        dense = np.unique(base ^ flips)
        by_lookup = simhash.link_list(dense)
    finally:
        simhash.LIST_LIMIT = limit
    assert (by_lookup == simhash.link_list(dense)).all()
    x = fps[:, None] ^ fps[None, :]
    a, b = np.nonzero(np.bitwise_count(x) <= 3)
    assert (small[a] == small[b]).all()


def test_simhash_index_is_never_broadcast(spark):
    # The 14 keys of a fingerprint, exploded, pass Spark's size check as one; at 0.6 GB they don't fit the driver.
    from leafmill.llm.simhash import links

    edges = links(spark.range(40).select((F.col("id") * 7 % 32).alias("fp")).distinct())
    assert edges.count() > 0
    edges.collect()
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "a", "a b", "a b c", "A b C d e", "x y z x y z x", "ÄÖ a b Ä"):
        words = "".join(c.lower() if c.isascii() else c for c in text).split()
        own = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in own]
        assert fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_bpe(spark, corpus):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = table(spark, corpus + [(400, "<|endoftext|> it's 'll 12  \n\n x", "s"), (401, "abcdefghij" * 3_000, "s")])
    want = Counter()
    for d, t, _ in [tuple(r) for r in texts.select("doc_id", "text", "source").collect()]:
        ids = enc.encode_ordinary(t or "")
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe_of(texts).collect())) == want
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe_decode(bpe_encode(texts, *args), *args)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((d, (t or "").encode()) for d, t in [(r.doc_id, r.text) for r in texts.collect()])


def test_bpe_joins_at_every_leaf_size():
    import public_tokenizers as P

    from leafmill.llm import bpe as M

    b = M.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    old = M.LEAF, M.LEAF_TEXT
    parts = ["a", "e", "l", "'", "'ll", "'re", " ", "  ", "\n", "é", "1", "23", "!", "$$", "日本", "😀", "the ", " ing", "\x1c", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)] + ["".join(rng.choices("abcdething", k=200)) for _ in range(60)]
    want = [b.encode(t) for t in texts]
    try:
        for M.LEAF, M.LEAF_TEXT in ((2, 3), (3, 7), (8, 20)):
            b.seen.clear()
            assert [b.encode(t) for t in texts] == want
    finally:
        M.LEAF, M.LEAF_TEXT = old
        b.seen.clear()


def test_mixing(spark, corpus):
    got = mix(table(spark, corpus), rows_per_bucket=7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(table(spark, corpus), rows_per_bucket=10_000).collect()))
    total = sum(len((t or "").encode().split()) for _, t, _ in corpus)
    of = {}
    for d, t, s in corpus:
        of.setdefault(s, []).append(len((t or "").encode().split()))
    targets = {r.source_size: r.target for r in got}
    assert abs(sum({s: targets[sum(x)] for s, x in of.items()}.values()) - 1.5 * total) < 1e-6 * total
    for s, x in of.items():
        assert targets[sum(x)] <= 2 * sum(x) + 1e-9
    for r in got:
        assert 0 <= r.taken <= 2 * r.size


def test_quality(spark):
    prose = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [
        (1, prose, ""), (2, None, ""), (3, "", ""), (4, prose + "\n" + " | ".join(["home"] * 5) + "\nsubscribe click here", ""),
        (5, "\n".join(["same line again and again"] * 20), ""), (6, " ".join(f"x{k}$$$" for k in range(80)), ""), (7, "BUY!! NOW!! " * 60, ""),
        (8, prose, ""), (8, prose, ""),
    ]
    got = {r.doc_id: r for r in quality_rules(table(spark, rows), with_text=True).collect()}
    assert {k for k, r in got.items() if r.kept} == {1, 4, 8}
    assert got[4].clean_text == prose and got[5].n_dup_lines == 19 and got[5].n_repeat_words == 100
    assert got[2].n_words == 0 and got[2].base_failed
    kept = keep_clean(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 8, 8] and kept.columns == table(spark, rows).columns


def test_chat_round_trip(spark):
    rng = random.Random(4)
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "a\\<|b", "", None, "plain words " * 40, "ü😀"]
    rows = []
    for c in [*range(12), None]:
        for k in range(rng.randint(1, 40)):
            role = "system" if k == 0 and (c or 0) % 2 == 0 else rng.choice(["user", "assistant", None, "od\nd\\/r<|le"])
            rows.append((c, k if k % 9 else None, role, rng.choice(nasty)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat_windows(df, max_tokens=120, history_tokens=30, chunk_turns=4)
    assert windows.filter("n_repeated > 0").count() > 0
    read = {}
    for r in read_windows(windows).collect():
        read.setdefault(r.conv_id, []).append(r)
    for c in {r[0] for r in rows}:
        own = sorted(((k is not None, k or 0, role or "", t or "") for conv, k, role, t in rows if conv == c))
        got = sorted(read[c], key=lambda r: r.window)
        assert [(t.role, t.text) for r in got for t in r.turns] == [(role, t) for _, _, role, t in own]
        assert "".join(r.loss_text for r in got) == "".join(t for _, _, role, t in own if role == "assistant")


def test_segments_are_maximal():
    import numpy as np

    rng = random.Random(6)
    for _ in range(300):
        x = [rng.choice([-3, -1, 2, 4, -0.5]) for _ in range(rng.randint(0, 12))]

        def split(a, z):
            best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            # The best stretch first, without zero-sum ends; then what lies on either side.
            s, _, i, j = best
            return split(a, i) + [(i, j, s)] + split(j, z)

        got = segments(np.array(x, float))
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in split(0, len(x))))


def test_toxicity(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1_200):
        own = rng.choices(words, k=rng.randint(5, 120))
        bad = k % 6 == 0
        if bad:
            for _ in range(4):
                own.insert(len(own) // 2, rng.choice(["vile", "nasty", "foul"]))
        rows.append((k, " ".join(own), "s"))
        if k % 2 == 0:
            labels.append((k, int(bad)))
    rows += [(5_000, None, "s"), (5_001, "", "s"), (None, "vile nasty foul vile", "s"), (5_002, "w1 " * 20_000, "s")]
    t = table(spark, rows)
    got = toxicity(t, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in got.collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [r for d, r in out.items() if d is not None and r.held_out and d < 1_200]
    hits = sum(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert held and hits / len(held) > 0.95
    assert out[None].predicted == 1 and not out[None].held_out
    assert out[5_000].score == out[5_001].score and out[5_002].predicted == 0


def test_queries_equal_sql(spark, sf_dir):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    for name, sql in Q.oracle_sql().items():
        got, want = Q.queries()[name](spark, sf_dir), c.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        show = lambda cols, data: Counter(tuple(str(r[cols.index(k)]) for k in order) for r in data)
        assert show(got.columns, map(tuple, got.collect())) == show(want.columns, want.fetchall()), name


def test_native_operators_have_no_python(spark, corpus):
    t = table(spark, corpus)
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (exact_dedup(t), quality_rules(t), mix(t), shard_rows(t), chat_windows(turns)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Cartesian"))


def test_sharding_is_uniform(spark):
    """Over seeds, each row meets each shard and each place alike."""
    rows = [(k, f"text {k}", "s") for k in range(24)]
    t, seen = table(spark, rows).cache(), Counter()
    for seed in range(40):
        for r in shard_rows(t, shards=4, seed=seed, rows_per_partition=5).collect():
            seen[(r.doc_id % 2, r.shard)] += 1
            seen[("slot", r.slot)] += 1
    assert all(seen[("slot", k)] == 160 for k in range(6))
    assert all(abs(seen[(odd, s)] - 120) < 45 for odd in range(2) for s in range(4))


def test_segments_and_spans():
    """The spans themselves, on whole numbers that leave no ties: each maximal stretch holds no better one."""
    import numpy as np

    rng = random.Random(7)
    for _ in range(200):
        x = [rng.choice([-1, 1]) * (2**k + rng.random() / 8) for k in rng.sample(range(10), rng.randint(0, 10))]

        def split(a, z):
            best = max(((sum(x[i:j]), i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=None)
            return [] if best is None or best[0] <= 0 else split(a, best[1]) + [(best[1], best[2])] + split(best[2], z)

        assert [(a, z) for a, z, _ in segments(np.array(x, float))] == split(0, len(x))


def test_toxicity_against_brute_force(spark):
    """Counts, priors, log-odds, segments and calibration by plain loops."""
    import math

    import numpy as np

    from leafmill.llm.toxicity import fit, score

    rng = random.Random(9)
    docs = []
    for k in range(400):
        own = rng.choices([f"w{i}" for i in range(40)], k=rng.randint(1, 40))
        if k % 5 == 0:
            own[len(own) // 2 : len(own) // 2] = rng.choices(["vile", "nasty"], k=3)
        docs.append((k, " ".join(own), int(k % 5 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, t string, toxic int")
    model = fit(df.select("doc_id", "t"), df.select("doc_id", "toxic"))
    check = {r.doc_id for r in df.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 3).select("doc_id").collect()}
    a, b = Counter(), Counter()
    for d, t, y in docs:
        if d not in check:
            (a if y else b).update(set(t.split()))
    n1, n0 = sum(a.values()), sum(b.values())
    prior, weights, rest = max(1.0, 0.1 * n1), {}, [0, 0]
    for w in a.keys() | b.keys():
        share = prior * (a[w] + b[w]) / (n1 + n0)
        p, q = a[w] + share + n1 / max(n1, n0), b[w] + share + n0 / max(n1, n0)
        delta, margin = math.log(p / (n1 + prior)) - math.log(q / (n0 + prior)), 2 * math.sqrt(1 / p + 1 / q)
        if abs(delta) > margin:
            weights[w] = math.copysign(abs(delta) - margin, delta)
        else:
            rest = [rest[0] + a[w], rest[1] + b[w]]
    drift = min(-0.02, math.log((rest[0] + prior) / (n1 + prior)) - math.log((rest[1] + prior) / (n0 + prior)))
    assert model.weights == pytest.approx(weights) and model.drift == pytest.approx(drift) and {"vile", "nasty"} <= set(weights)

    def best(words):
        s = [weights.get(w, drift) for w in words]
        return max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if sum(s[i:j]) > 0), default=None)

    null = [(s, math.log(len(t.split()))) for d, t, y in docs if d in check and not y and (s := best(t.split())) is not None]
    beta = max(0.25, float(np.std([s - n for s, n in null])) * math.sqrt(6) / math.pi) if len(null) > 9 else 1.0
    mu = float(np.mean([s - beta * n for s, n in null])) - 0.5772156649 * beta if len(null) > 9 else 0.0
    assert (model.beta, model.mu) == pytest.approx((beta, mu))
    for _, t, _ in docs[:60]:
        words = t.split()
        top = best(words)
        strength = -5.0 if top is None else (top - mu - beta * math.log(len(words))) / beta
        found = score(words, model)[1]
        assert max((s for *_, s in found), default=None) == (pytest.approx(strength) if strength > 0 else None)


def test_exchange_does_not_grow_with_buckets():
    """Bytes of the rows of stage 1, as Spark stores them, over the number of buckets."""
    import numpy as np
    import pyarrow as pa

    from leafmill.llm import packed as K

    rng = np.random.default_rng(3)
    texts = pa.array([b"x" * 1_000] * 4_000, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000), pa.int64()), texts], ["doc_id", "body"])
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def size(nb):
        symbols = lambda t: (rng.integers(0, 1 << 47, 800 * len(t)).astype(np.uint64), np.repeat(np.arange(len(t)), 800))
        rows = [r for b in K.symbols_stage(iter([batch]), nb, symbols, lambda t: nothing) for r in b.column("body").to_pylist()]
        return sum(64 + len(r) for r in rows)

    few, many = size(65), size(50_001)
    assert many < 1.25 * few


def test_hot_symbol_sends_one_entry_per_gathering():
    import numpy as np

    from leafmill.llm import packed as K

    out = K.Out(65)
    sent = []
    for _ in range(100):
        out.gather("x", lambda s: sent.append(np.unique(s)), np.full(10_000, 7, np.uint64))
    list(out.finish())
    assert sum(map(len, sent)) <= 1 + 100 * 10_000 // out.limit


def test_suffix_sorting_goes_through_the_disk(monkeypatch):
    """At its production limit a shard of the usual size spills, and sorts the same."""
    from leafmill.llm import induced

    rng = random.Random(3)
    text = [rng.randint(1, 60) for _ in range(150_000)]
    text[100_000:140_000] = text[20_000:60_000]
    made = []
    own = induced.spool
    monkeypatch.setattr(induced, "spool", lambda: made.append(1) or own())
    on_disk = induced.suffix_array(text, induced.LIMIT)
    assert made
    made.clear()
    assert induced.suffix_array(text, 10**9) == on_disk and not made
