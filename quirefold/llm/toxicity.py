"""Toxicity by maximum-scoring segments of token log-odds.

Learning: log-odds of a token's presence in toxic against other documents, with Dirichlet priors that are
themselves learnt one level up: a word leans on its first six letters, those on the first five, and these on
four, so an unseen form of a known stem still tells. A token keeps its prior unless a likelihood-ratio test
rejects it; then its estimate is moved back towards the prior by its standard error. A drift is taken off every
token, so that texts without evidence sink.

Scoring: one linear scan over the whole text finds every maximal segment of positive score. Scores of a text's
segments are combined by the sum statistics of extreme-value theory, with lambda and K estimated from the clean
documents of the sample, and a logistic curve over that evidence gives the probability.

The model is fitted on the driver, on at most SAMPLE documents and SAMPLE_BYTES bytes of text of each class (those
whose ids hash lowest).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import mapped, remainder, table
from .near_copies import SIMILARITY, alike, shingles

#: Bounds of the sample that the model is fitted on: documents and bytes of text of each label.
SAMPLE, SAMPLE_BYTES = 4000, 64_000_000
PRIOR, CAUTION, DRIFT, PREFIXES = 50.0, 2.0, 1.0, (4, 5, 6)
#: Twice the log-likelihood ratio from which a token departs from its prior: few of a hundred thousand do by chance.
SURE = 22.0
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
CACHE = 200_000
BANDS, ROWS, SEED = 20, 5, 42
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in order, by the linear-time algorithm.

    scores: position and score of the tokens whose score is positive; every other token scores -drift.
    """
    kept: list[list] = []  # first, last, sum before, sum after, place of the nearest segment before it whose sum before is lower
    total, at = 0.0, -1
    for pos, s in scores:
        total -= drift * (pos - at - 1)
        seg = [pos, pos, total, total + s]
        total += s
        at = pos
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= seg[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append([*seg, j])
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            lower = kept[j][4]
            del kept[j:]
            j = lower
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def minhash_bands(hashes: np.ndarray) -> list[int]:
    """One key per band of MinHash values, as signed longs; texts without shingles share all theirs."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for lo in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[lo : lo + 4096] * _FACTORS + _SHIFTS).min(1))
    raw = least.tobytes()
    step = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) - 2**63 for i in range(BANDS)]


def apart(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """Without near copies (five-word similarity of 0.8 or more) of earlier texts, which are no evidence of their own.

    Candidates share a band of MinHash values and are compared on all their shingles: a line that texts share costs none.
    """
    held: dict[tuple[int, int], list[int]] = {}
    sets, kept = [], []
    for text, y in zip(texts, labels, strict=True):
        own = shingles(text)
        keys = list(enumerate(minhash_bands(own)))
        if any(alike(own, sets[i], SIMILARITY) for i in {i for k in keys for i in held.get(k, ())}):
            continue
        for k in keys:
            held.setdefault(k, []).append(len(sets))
        sets.append(own)
        kept.append((text, y))
    return [t for t, _ in kept], [y for _, y in kept]


class Model:
    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.lam, self.k = 1.0, 1.0
        self.bias, self.slope = -3.0, 1.0

    # -- token scores
    def score(self, word: str) -> float:
        w = self.weight.get(word)
        if w is None:
            w = 0.0
            for n in reversed(PREFIXES):
                if (w := self.weight.get("^" + word[:n])) is not None:
                    break
            w = (w or 0.0)
        return w - DRIFT

    def fit(self, texts: list[str], labels: list[int]) -> Model:
        n = [labels.count(0), labels.count(1)]
        if not n[0] or not n[1]:
            rate = n[1] / max(1, sum(n))
            self.bias, self.slope = (3.0 if rate > 0.5 else -3.0), 0.0
            return self
        texts, labels = apart(texts, labels)
        n = [labels.count(0), labels.count(1)]
        words = [Counter(), Counter()]
        levels = {k: [Counter(), Counter()] for k in PREFIXES}
        for text, y in zip(texts, labels, strict=True):
            seen = set(WORD.findall(text.lower()))
            words[y].update(seen)
            for k in PREFIXES:
                levels[k][y].update({w[:k] for w in seen if len(w) >= k})
        known: dict[str, float] = {}

        def learn(counts, prior, name) -> None:
            for item in sorted(counts[0].keys() | counts[1].keys()):
                n0, n1 = counts[0][item], counts[1][item]
                lean = prior(item)
                q = n[1] * math.exp(lean) / (n[1] * math.exp(lean) + n[0])
                p = (n0 + n1) / (n[0] + n[1])
                told = 2 * sum(x * math.log(x / ((n0 + n1) * e)) for x, e in ((n1, q), (n0, 1 - q)) if x)
                if told < SURE:
                    known[name(item)] = lean
                    continue
                a1, a0 = PRIOR * p * math.exp(lean / 2), PRIOR * p * math.exp(-lean / 2)
                delta = math.log((n1 + a1) / (n[1] + PRIOR)) - math.log((n0 + a0) / (n[0] + PRIOR))
                room = CAUTION * math.sqrt(1 / (n1 + a1) + 1 / (n0 + a0))
                known[name(item)] = lean + math.copysign(max(0.0, abs(delta - lean) - room), delta - lean)

        below = None
        for k in PREFIXES:
            learn(levels[k], (lambda s, b=below: known["^" + s[:b]]) if below else (lambda s: 0.0), lambda s: "^" + s)
            below = k
        stem = lambda w: next((known["^" + w[:k]] for k in reversed(PREFIXES) if len(w) >= k), 0.0)
        learn(words, stem, lambda w: w)
        # a word that says what its stem says need not be kept
        self.weight = {w: v for w, v in known.items() if w[0] == "^" and v or w[0] != "^" and abs(v - stem(w)) > 1e-9}
        for w in [w for w in known if w[0] == "^" and not known[w] and len(w) > 1 + PREFIXES[0]]:
            self.weight[w] = 0.0
        self._calibrate(texts, labels)
        return self

    # -- passages and evidence
    def passages(self, text: str, cache: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall(text.lower())
        hits = []
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:
                if len(cache) >= CACHE:
                    cache.clear()
                s = cache[w] = self.score(w)
            if s > 0:
                hits.append((i, s))
        return len(words), segments(hits, DRIFT) if hits else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """The strongest sum statistic over the r best segments, r = 1, 2, ..."""
        best, total, base = 0.0, 0.0, math.log(self.k * max(1, n))
        for r, s in enumerate(sorted((s for *_, s in found), reverse=True), 1):
            total += self.lam * s
            best = max(best, total - r * base + math.lgamma(r + 1))
        return best

    def probability(self, evidence: float) -> float:
        z = self.bias + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

    def _calibrate(self, texts: list[str], labels: list[int]) -> None:
        cache: dict[str, float] = {}
        found = [self.passages(t, cache) for t in texts]
        clean = [(t, f) for t, f, y in zip(texts, found, labels, strict=True) if y == 0]
        words, tally = Counter(), Counter()
        for t, _ in clean:
            words.update(WORD.findall(t.lower()))
        for w, n in words.items():
            tally[round(self.score(w), 3)] += n
        s, c = np.array(list(tally)) if tally else np.zeros(1), np.array(list(tally.values()), float) if tally else np.ones(1)
        lo, hi = 0.05, 1.5  # sum p e^(lambda s) = 1 has its positive root here or is taken as the nearer end
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (c * np.exp(mid * s)).sum() < c.sum() else (lo, mid)
        self.lam = lo
        tops = [max((x[2] for x in f[1]), default=0.0) for _, f in clean]
        sizes = [math.log(max(1, f[0])) for _, f in clean]
        self.k = min(1.0, max(1e-4, math.exp(self.lam * float(np.mean(tops)) - 0.5772 - float(np.mean(sizes)))))
        x = np.array([math.log1p(self.evidence(*f)) for f in found])
        y, beta, ridge = np.array(labels, float), np.zeros(2), np.diag([1e-3, 0.05])
        a = np.stack([np.ones_like(x), x], 1)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ beta)
            beta += np.clip(step, -2, 2)
        self.bias, self.slope = float(beta[0]), max(0.0, float(beta[1]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `sample` documents of each label, those whose ids hash lowest, of at most sample_bytes in all.

    Rows without a label or text don't count; of rows that repeat an id the least text counts, and a repeated label
    once. Where a label, the labels or the documents are missing, every text scores below one half. Other columns
    play no part.
    """
    named = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    place = F.xxhash64("id")
    ids = reduce(DataFrame.unionByName, [named.filter(F.col("y") == y).orderBy(place, "id").limit(sample) for y in (0, 1)])
    # at most 2 * sample rows, so it may be broadcast; as many come out, repeated ids being added up before the shuffle
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("y").orderBy(place, "id"))
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_bytes).select("text", "y").toPandas()
    rows = rows.sort_values(["y", "text"]).drop_duplicates()  # copies are one piece of evidence
    return Model().fit(rows["text"].tolist(), [int(y) for y in rows["y"]])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns (the id by default) with score, predicted and passages.

    passages: start, end (code points of the lower-cased text's words) and score of each maximal segment. A null
    or empty text has none, and the score that no evidence gives. Every row is scored by itself, so nulls and
    repeats in other columns change nothing; an empty table gives an empty result. Carried columns may have any
    names; one that bears the name of a result gives way to it. text_col may be a field of a struct (a.b).
    """
    cache: dict[str, float] = {}

    def make(texts: list) -> list[list]:
        p, spans = [], []
        for text in texts:
            text = (text or "").lower()
            n, found = model.passages(text, cache)
            p.append(model.probability(model.evidence(n, found)))
            where = [m.span() for m in WORD.finditer(text)] if found else []
            spans.append([{"start": where[x][0], "end": where[y][1], "score": s} for x, y, s in found])
        return [p, [int(x >= threshold) for x in p], spans]

    return mapped(docs, carry or [id_col], text_col, "score double, predicted int, passages array<struct<start:int,end:int,score:double>>", make)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels whose id leaves remainder 0 or 2 by 3 (see learn and score for odd rows)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1))
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )
