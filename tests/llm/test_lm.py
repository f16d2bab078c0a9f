import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import lm as m

from ..oracle import DATA
from .conftest import ROWS


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute3(rows, mu=m.MU):
    """As brute, at order 3: by dictionaries of all n-grams, each history backing off to the one without its first token."""
    texts = [(tokens(t), train) for t, train in rows]
    held = Counter(tuple(t[i : i + n]) for t, train in texts if train for n in (1, 2, 3) for i in range(len(t) - n + 1))
    n, v = sum(c for g, c in held.items() if len(g) == 1), sum(len(g) == 1 for g in held)

    def p(history, w):
        if not history:
            return (held[w,] + 0.1) / (n + 0.1 * (v + 1))
        return (held[*history, w] + mu * p(history[1:], w)) / (held[history] + mu)

    out = []
    for t, _ in texts:
        score = sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t))
        out.append((len(t), sum(held[w,] > 0 for w in t), n, sum(math.log10(p((), w)) for w in t), score))
    return out


def brute(rows):
    """(tokens, known, N, base, score) of (text, train) by dictionaries."""
    texts = [(tokens(t), train) for t, train in rows]
    one = Counter(w for t, train in texts if train for w in t)
    two = Counter(p for t, train in texts if train for p in zip(t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for t, _ in texts:
        s = math.log10(p(t[0]))
        for a, b in zip(t, t[1:], strict=False):
            s += math.log10((two[a, b] + m.MU * p(b)) / (one[a] + m.MU))
        out.append((len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), s))
    return out


def same(got, want):
    key = lambda x: (x[0], x[1], round(x[3], 3), round(x[4], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-5)


def taken(df):
    return [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def test_rows(docs, none):
    got = taken(m.score_documents(docs, F.col("lang") == "en"))
    same(got, brute([(r[1], r[2] == "en") for r in ROWS]))
    assert m.score_documents(none, F.lit(True)).collect() == []
    same(taken(m.score_documents(docs, F.lit(False))), brute([(r[1], False) for r in ROWS]))


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = m.op9_lm_scoring(spark, DATA)
    # the query's model is of order 3
    same(taken(got), brute3([(r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in rows]))


def test_order_three(docs, none, monkeypatch):
    """Against dictionaries, with texts longer than a lane and several parts and buckets."""
    monkeypatch.setattr(m, "PART", 300)
    monkeypatch.setattr(m, "PER_BUCKET", 2000)
    monkeypatch.setattr(m, "LANE", 7)
    want = brute3([(r[1], r[2] == "en") for r in ROWS])
    same(taken(m.score_documents(docs, F.col("lang") == "en", order=3)), want)
    assert m.score_documents(none, F.lit(True), order=3).collect() == []
    same(taken(m.score_documents(docs, F.lit(False), order=3)), brute3([(r[1], False) for r in ROWS]))


def test_automaton():
    """States, arcs and failure arcs of one part: what each state gives all tokens sums to one, by arcs or by failure."""
    rnd = np.random.default_rng(2)
    texts = [list(rnd.integers(0, 5, n)) + [5] for n in (0, 1, 2, 40, 300)] * 2
    texts[3] = [6, 0, 6, 5]  # the one text that is not learnt from, and a word that it alone has
    words = np.sort(rnd.integers(1, 2**63, 7, dtype=np.uint64))
    seq = np.concatenate([np.array(t) for t in texts])
    part = m.Part(m.planes(words), m.planes(seq.astype(np.uint32)), [len(t) for t in texts], [i != 3 for i in range(10)])
    a = m.Automaton(part, [], 0, int(part.train.sum()), 6, order=3)
    for history in [(), *[(u,) for u in range(5)], *[(u, v) for u in range(5) for v in range(5)]]:
        assert sum(10 ** _walked(a, part, [*history, w]) for w in range(7)) == pytest.approx(1, abs=1e-9), history
    at, walked = 0, a.walk()
    for t in texts:  # the walk carries its state to the same weights
        assert walked[at : at + len(t)] == pytest.approx([_walked(a, part, t[max(0, i - 2) : i + 1]) for i in range(len(t))])
        at += len(t)


def _walked(a, part, t):
    """The weight of t's last token by the automaton's states and arcs, followed one by one; -inf where no arc can be."""
    at = {}
    for i in range(len(part.seq)):
        for k in (1, 2):
            if a.places[k - 1][i] >= 0:
                at[tuple(part.seq[i - k : i + 1])] = int(a.places[k - 1][i])
    seen = lambda g: g in at and a.there[len(g) - 1][at[g]]
    history, cost = tuple(t[:-1]), 0.0
    while len(history) == 2 and not seen(history):  # no such state
        history = history[1:]
    while history:
        if seen((*history, t[-1])):
            return cost + a.arcs[len(history)][at[*history, t[-1]]]
        cost += a.failures[len(history)][history[0] if len(history) == 1 else at[history]]
        history = history[1:]
    return cost + a.arcs[0][t[-1]]


def test_states_sum_to_one():
    rows = [("a b a c", True), ("b a", True)]
    texts = [tokens(t) for t, _ in rows]
    one = Counter(w for t in texts for w in t)
    two = Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    p = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in one.items()} | {"unknown": 0.1 / (n + 0.1 * (v + 1))}
    for a in ("a", "b", "c"):
        assert sum((two[a, w] + m.MU * q) / (one[a] + m.MU) for w, q in p.items()) == pytest.approx(1)


def test_codings():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**64, 999, dtype=np.uint64))
    assert (m.unpacked(m.packed(h)) == h).all() and (m.unpacked(m.packed(h[:1])) == h[:1]).all()
    n = rng.integers(0, 3, 50)
    assert (m.uncounted(m.counted(n, 1), 50, 1) == n).all() and (m.wide(m.narrow(n * 70_000)) == n * 70_000).all()
    assert (m.unplanes(m.planes(h), np.uint64) == h).all()
