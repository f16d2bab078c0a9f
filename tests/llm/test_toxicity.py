import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import toxicity as m

from ..oracle import DATA
from .conftest import ROWS


def brute(scores):
    """Maximal segments by their definition: recursively the best segment, then what lies left and right of it."""
    def go(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0, 0))
        if best[0] <= 1e-9:
            return []
        a, b = best[3:]
        return [*go(lo, a), (a, b - 1, best[0]), *go(b, hi)]

    return go(0, len(scores))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(None), st.sampled_from([0.7, 1.3, 2.9, 4.1])), max_size=12))
def test_segments(tokens):
    got = m.segments([(i, s) for i, s in enumerate(tokens) if s], 1.0)
    want = brute([-1.0 if s is None else s for s in tokens])
    assert sum(round(x[2], 6) for x in got) == round(sum(x[2] for x in want), 6) or [x[:2] for x in got] == [x[:2] for x in want]
    assert all(b < c for (_, b, _), (c, _, _) in itertools.pairwise(got))


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [a + b for a in "ka lo mi ne ru ta".split() for b in "bel dor fin gus hap".split()]
    bad = [s + e for s in ("zorvik", "quabble") for e in ("a", "en", "ish", "um", "os")]
    out = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        if y := int(i % 6 == 0):
            for _ in range(3):
                t.insert(rnd.randrange(len(t)), rnd.choice(bad))
        out.append((i, " ".join(t), y))
    return out


def test_learnt_stems(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 700], "doc_id long, toxic int")
    model = m.learn(docs, labels)
    got = {r.doc_id: r.predicted for r in m.score(docs, model).collect()}
    assert sum(got[i] == y for i, _, y in rows if i >= 700) >= 195
    # a form that was never seen, of a known stem
    assert model.score("zorvikantum") > 1 and model.score("kabel") < 0
    found = m.score(spark.createDataFrame([(1, "Kabel lodor. ZORVIKA quabbleum! minebel")], "doc_id long, text string"), model).first()
    assert [("Kabel lodor. ZORVIKA quabbleum! minebel"[p.start : p.end]) for p in found.passages] == ["ZORVIKA quabbleum"]


def test_rows(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = m.learn(docs, labels)  # no labels: nothing is known
    got = m.score(docs, model, carry=["doc_id", "n_chars"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert m.score(none, model).collect() == []


def test_query(spark):
    got = m.op10_toxicity(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_many_segments():
    """100,000 segments that never join; the scan stays linear."""
    assert len(m.segments([(3 * i, 1.0) for i in range(100_000)], 1.0)) == 100_000
    assert len(m.segments([(0, 1e6)] + [(4 * i + 4, 2.5) for i in range(100_000)], 1.0)) == 100_001


def test_calibrated_on_all_clean_documents():
    """Also those that come after the first thousand."""
    texts = ["plain words only"] * 1000 + ["plain bad words"] * 500 + ["bad bad words"] * 50
    labels, lam = [0] * 1500 + [1] * 50, []
    for order in (1, -1):
        model = m.Model()
        model.weight = {"bad": 3.0}
        model._calibrate(texts[::order], labels[::order])
        lam.append(model.lam)
    assert abs(lam[0] - lam[1]) < 1e-9 and 0.05 < lam[0] < 1.49
