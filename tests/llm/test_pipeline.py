"""The corpus pipeline against a brute-force version of its stages."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


FURNITURE = re.compile(
    r"(?i)(accept cookies|all rights reserved|privacy policy|terms of (use|service)|sign up|log ?in|subscribe|click here|enable javascript|back to top|skip to content"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|jetzt anmelden|hier klicken|nach oben|zum inhalt springen"
    r"|tous droits réservés|politique de confidentialité|conditions d.utilisation|accepter les cookies|cliquez ici|haut de page|aller au contenu"
    r"|todos los derechos reservados|política de privacidad|términos de uso|aceptar cookies|haga clic aquí|volver arriba|saltar al contenido)"
)


def line_fails(line):
    own = WORD.findall(line)
    n = len(own)
    bars = sum(bool(re.fullmatch(r"[|>»·•/]+", w)) for w in own)
    marks, shouts = len(re.findall(r"[#*$%&|<>]", line)), len(re.findall(r"[!?]{2,}", line))
    says = any(c.isalnum() for c in line)
    return n > 0 and (marks > n * 0.3 or shouts > n * 0.3 or bars > n * 0.2 or not says or (n <= 30 and bool(FURNITURE.search(line))))


def cleaned(text):
    """The text without failing lines; None for a document that goes."""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    kept = "\n".join(x for x in text.split("\n") if not line_fails(x))
    if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and len(WORD.findall(kept)) >= 0.7 * len(words):
        return kept
    return None


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    clean = [(d, c, s) for d, t, s in docs if (c := cleaned(t or "")) is not None]
    first = {}
    for d, t, _ in clean:
        first[t] = min(d, first.get(t, d))
    exact = [x for x in clean if first[x[1]] == x[0]]
    own = {d: shingles(t) for d, t, _ in exact}
    root = {}
    for d in sorted(own):
        near = [e for e in root if 5 * len(own[e] & own[d]) >= 4 * len(own[e] | own[d])]
        best = min([d, *[root[e] for e in near]])
        old = {root[e] for e in near}
        root[d] = best
        for e in root:
            if root[e] in old:
                root[e] = best
    near = [x for x in exact if root[x[0]] == x[0]]
    size = {d: len(WORD.findall(t)) for d, t, _ in near}
    sources = sorted({s for *_, s in near})
    own = {s: sum(size[d] for d, _, x in near if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, pool = {}, 1.5 * sum(own.values())
    open_ = set(sources)
    while True:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if pool * weight[s] / total >= 2 * own[s]}
        if not full:
            target |= {s: pool * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * own[s] for s in full}
        pool -= sum(2 * own[s] for s in full)
        open_ -= full
        if not open_:
            break
    times = {}
    for s in sources:
        keyed = []
        for d, t, x in near:
            if x == s:
                u = (int(hashlib.md5(f"42:{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                w = max(0.25, 1 - 2 * len(re.findall(r"[0-9#*$%&|<>{}]", t)) / max(1, len(t)))
                keyed.append((-math.log(u) / w, d))
        epochs = int(target[s] // own[s])
        left, start = target[s] - epochs * own[s], 0
        for _, d in sorted(keyed):
            times[d] = epochs + (2 * start + size[d] <= 2 * left)
            start += size[d]
    return [(d, t) for d, t, _ in near for _ in range(times[d])]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "bpe_encoding"]


def test_equals_brute_force(spark, sf_dir):
    import public_tokenizers as P
    import tiktoken

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in brute(docs):
        ids = enc.encode_ordinary(t)
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == want and len(got) > 20


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


#: Names that stages and operators use inside.
CLASHES = ("time", "times", "taken", "taken_id", "_time", "_times", "_row", "_doc", "_gone", "row", "kept", "h", "t", "node", "size", "key", "n", "at", "_metadata", "a b", "x.y")


def prose(k):
    return " ".join(f"word{k}x{i}" for i in range(60)) + "."


def odd(spark, rows, with_files):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "length(text) AS n_chars")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    if with_files:
        from leafmill.llm.common import shared_dir

        at = f"{shared_dir(spark)}/odd-{len(rows)}-{random.random()}"
        docs.drop("_metadata").repartition(3, "doc_id").write.parquet(at)
        docs = spark.read.parquet(at)
    return docs


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept_rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


@pytest.mark.parametrize("with_files", [False, True])
def test_stages_on_odd_rows(spark, sf_dir, with_files):
    p, q, long = prose(1), prose(2), " ".join(f"w{i}" for i in range(60_000))
    nav = p + "\nhome | about | contact\n" + "!!!\n- -"
    rows = [(1, p, "a"), (3, p, "a"), (3, p, "a"), (3, q, None), (None, p, "b"), (None, p, "b"), (None, prose(4), "b"), (None, prose(4), "b"), (None, prose(5), "c")]
    rows += [(6, None, "a"), (7, "", "a"), (8, nav, "b"), (9, long, "a"), (9, long, "a"), (10, nav, "b")]
    docs = odd(spark, rows, with_files)
    out = stage("quality_rules")(spark, docs, sf_dir)
    clean = [(d, p if t == nav else t, s) for d, t, s in rows if t]
    assert out.columns == docs.columns and kept_rows(out) == Counter(clean)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    docs = odd(spark, [*clean, (11, None, None), (12, "", "a"), (None, "", "b")], with_files)
    want = Counter([(1, p, "a"), (3, q, None), (None, prose(4), "b"), (None, prose(5), "c"), (9, long, "a"), (11, None, None)])
    for name in ("exact_dedup", "simhash_near_dedup"):
        out = stage(name)(spark, docs, sf_dir)
        assert out.columns == docs.columns and kept_rows(out) == want, name
    docs = odd(spark, [*want, *want, (13, "", "z")], with_files)
    out = stage("source_mixing")(spark, docs, sf_dir)
    assert out.columns == docs.columns
    times, had = kept_rows(out), kept_rows(docs)
    assert set(times) <= set(want) - {(11, None, None)} and all(n <= 2 * had[x] for x, n in times.items())
    out = stage("bpe_encoding")(spark, docs, sf_dir)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())
    assert {r.n_tokens for r in out.collect() if r.doc_id in (11, 13)} == {0}


def test_stages_on_empty_tables(spark, sf_dir):
    none = odd(spark, [(1, "x", "a")], False).limit(0)
    for name, stage_of in corpus_pipeline.STAGES:
        out = stage_of(spark, none, sf_dir)
        assert out.count() == 0 and (name == "bpe_encoding" or out.columns == none.columns)


def test_run_removes_what_it_wrote(spark, tmp_path):
    import os

    from leafmill.llm.common import shared_dir

    files = lambda: {os.path.join(a, f) for a, _, names in os.walk(shared_dir(spark).removeprefix("file:")) for f in names if not f.endswith(".crc")}
    docs = odd(spark, [(k, prose(k), "a") for k in range(5)], False).select("doc_id", "text", "source", "lang", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = files()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert all("4-bpe_encoding" in f for f in files() - before)
