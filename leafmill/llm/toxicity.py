"""Toxicity by maximum-scoring segments.

Model: log-odds of tokens between toxic and other texts, under Dirichlet priors proportional to the
background, in both directions: a token of toxic texts counts for a passage, one of harmless texts
against it, each by what is certain of its log-odds (beyond two standard deviations). Tokens whose
log-odds may be chance share those of all such tokens together, so the score drifts down over
ordinary words and a passage must outweigh it.

Scan: one pass over a text's log-odds finds all maximal scoring segments, each disjoint and not
improvable. For texts of n tokens without toxicity, the best segment follows an extreme-value law
whose location grows with ln n; a segment's expected number of chance equals is its calibrated
strength. The best segment's strength and the sum over all significant segments are turned into a
probability by a logistic fit.

Fitting sees at most `max_train` labelled rows, the first by a hash of the id. All tokens of these
rows are counted, without a cap; the driver gets those whose log-odds are certain, and three numbers
a calibration text. Scoring reads every text whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: ASCII marks that only surround or split words.
MARKS = str.maketrans({c: " " for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"})


def tokens(text: str) -> list[str]:
    return text.translate(MARKS).lower().split()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    drift: float
    #: Of the extreme-value law of the best segment of a harmless text: location at n = 1, and scale.
    mu: float
    beta: float
    #: Intercept, best segment, all significant segments.
    logit: tuple[float, float, float]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass.

    Only positive scores begin or end a segment, so the pass visits those. The stack holds candidate
    segments by the sums before (l) and after (r) them; a newcomer merges back to the latest one that
    starts lower, as long as that one doesn't end higher.
    """
    up = np.nonzero(scores > 0)[0]
    if not len(up):
        return []
    after = np.cumsum(scores)
    r_all = after[up]
    l_all = r_all - scores[up]
    stack: list[list] = []  # start, end, l, r, index of the latest earlier with a lower l (or -1)
    for i, l, r in zip(up.tolist(), l_all.tolist(), r_all.tolist(), strict=True):
        start, end = i, i + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= l:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= r:
                break
            start, l = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append([start, end, l, r, j])
    return [(a, z, r - l) for a, z, l, r, _ in stack]


def text_scores(words: list[str], weights: dict[str, float], drift: float) -> np.ndarray:
    get = weights.get
    return np.array([get(w, drift) for w in words])


def strengths(words: list[str], weights: dict[str, float], drift: float, mu: float, beta: float) -> list[tuple[int, int, float]]:
    """Segments with calibrated strength: minus the log of the expected number of chance equals."""
    shift = mu + beta * math.log(max(1, len(words)))
    return [(a, z, (s - shift) / beta) for a, z, s in segments(text_scores(words, weights, drift))]


def _features(found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The best strength and the sum of the significant ones, on a scale that flattens without an end."""
    return math.asinh(max((s for *_, s in found), default=-5.0)), math.asinh(sum(s for *_, s in found if s > 0))


def score(words: list[str], m: Model) -> tuple[float, list[tuple[int, int, float]]]:
    found = strengths(words, m.weights, m.drift, m.mu, m.beta)
    x = (1.0, *_features(found))
    z = sum(a * b for a, b in zip(m.logit, x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [f for f in found if f[2] > 0]


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def sure_log_odds(a: Column, b: Column, n1: int, n0: int, prior: float, deviations: float) -> Column:
    """What is certain of a token's log-odds, toxic (a of n1) against other texts (b of n0); 0 where
    chance may have made it. Priors follow the token's share in both together, and hold a pseudo-count
    more, in proportion to the classes, so that a token without counts is neutral."""
    share = (a + b) / F.lit(float(max(1, n1 + n0))) * F.lit(prior)
    more = max(n1, n0, 1)
    toxic, other = a + share + F.lit(max(n1, 1) / more), b + share + F.lit(max(n0, 1) / more)
    delta = F.log(toxic / F.lit(n1 + prior)) - F.log(other / F.lit(n0 + prior))
    margin = F.lit(deviations) * F.sqrt(F.lit(1.0) / toxic + F.lit(1.0) / other)
    return F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - margin)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 50_000, prior_share: float = 0.1, deviations: float = 2.0, least_drift: float = 0.02) -> Model:
    """docs: doc_id, t. labels: doc_id, toxic (only rows to learn from). Repeated labels of an id count
    as toxic if any is. Equal texts are one, toxic if any is, and a token counts once in a text. Three quarters of
    the sample give the counts, the rest the calibration. The prior is as strong as a share of the toxic counts."""
    of = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # Bounded by max_train, so it is kept: all passes over it read the texts of the table once.
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("t").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    sample = cut(texts.select("t", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 3).alias("check")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(set(tokens(t)))
        for y, counts in seen.items():
            names, numbers = list(counts), list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([y] * len(names), pa.int32()), pa.array(numbers, pa.int64())], ["w", "y", "n"])

    counted = sample.filter("NOT check").select("t", "toxic").mapInArrow(count, "w string, y int, n long")
    of_class = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    words = cut(counted.groupBy("w").agg(of_class(1).alias("a"), of_class(0).alias("b")))
    n1, n0 = words.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    prior = max(1.0, prior_share * n1)
    weighed = words.withColumn("s", sure_log_odds(F.col("a"), F.col("b"), n1, n0, prior, deviations))
    weights = {r["w"]: r["s"] for r in weighed.filter("s <> 0").select("w", "s").collect()}
    rest1, rest0 = weighed.filter("s = 0").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    drift = min(-least_drift, math.log((rest1 + prior) / (n1 + prior)) - math.log((rest0 + prior) / (n0 + prior)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [tokens(t) for t in b.column(0).to_pylist()]
            top = [max((s for *_, s in segments(text_scores(w, weights, drift))), default=None) for w in own]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([max(1, len(w)) for w in own], pa.int64()), pa.array(top, pa.float64())], ["y", "n", "s"])

    check = sample.filter("check").select("t", "toxic")
    # Extreme values of harmless texts: Gumbel by moments, over those that have a segment at all.
    null = np.array([(r["s"], math.log(r["n"])) for r in check.mapInArrow(best, "y int, n long, s double").filter("y = 0 AND s IS NOT NULL").collect()]).reshape(-1, 2)
    beta = max(0.25, float(np.std(null[:, 0] - null[:, 1]) * math.sqrt(6) / math.pi)) if len(null) > 9 else 1.0
    mu = float(np.mean(null[:, 0] - beta * null[:, 1]) - 0.5772156649 * beta) if len(null) > 9 else 0.0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_features(strengths(tokens(t), weights, drift, mu, beta)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array([g[k] for g in got], pa.float64()) for k in range(2)]], ["y", "best", "total"])

    rows = sorted(map(tuple, check.mapInArrow(features, "y int, best double, total double").collect()))
    y, x = np.array([r[0] for r in rows], float), np.array([(1.0, *r[1:]) for r in rows]).reshape(-1, 3)
    logit = fit_logit(x, y) if len(y) else (-3.0, 0.0, 0.0)
    return Model(weights, drift, mu, beta, logit)  # type: ignore[arg-type]


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 50_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_passages, passages (word start, end
    and strength of each significant segment).

    Labels of held-out ids (crc32 of the id as text mod 4 is 2) are never looked at. Null and empty
    texts have no segment and get the score of such texts. Without any label, or with one class only,
    scores are the prior's. Null ids are not held out. Extra columns are ignored.
    """
    held = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    learn = labels.select("doc_id", "toxic").filter(~held("doc_id"))
    model = fit(rows, learn, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [score(tokens(t), model) for t in b.column(1).to_pylist()]
            passages = [[{"start": a, "end": z, "strength": s} for a, z, s in found] for _, found in got]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strength", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p for p, _ in got], pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"]
            )

    scored = rows.mapInArrow(run, "doc_id long, score double, passages array<struct<start:int,end:int,strength:double>>")
    return scored.select(
        "doc_id",
        held("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
        "passages",
    )
