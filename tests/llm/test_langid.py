import zlib

import numpy as np

from quirefold.llm import langid as m

from .conftest import ROWS


def test_kernel_is_of_sets():
    a, b = m.grams("banana"), m.grams("BANANA")
    assert (a == b).all() and len(a) == 3 + 3 + 3  # a b n; ba an na; ban ana nan
    k = m.presence([a, m.grams("bandana"), m.grams("")])
    s, t = set(a.tolist()), set(m.grams("bandana").tolist())
    assert abs(float(k[0] @ k[1]) - len(s & t) / (len(s) * len(t)) ** 0.5) < 1e-5 and not k[2].any()


def test_collapsed_product_is_the_kernel_model():
    texts, langs = ["der hund und die katze", "the dog and the cat", "und das haus", "and that house"] * 3, ["de", "en"] * 6
    model = m.Model(texts, langs, landmarks=4)
    assert [x[0] for x in model.predict(["die maus und das haus", "the mouse and house"])] == ["de", "en"]
    assert np.isfinite(model.weights).all()


def test_rows(docs, none):
    model = m.learn(docs)
    got = {r.doc_id: r for r in m.identify(docs, model, carry=["doc_id", "lang"]).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    assert (got[3].lang_pred, got[4].lang_pred, got[8].lang_pred, got[8].score) == ("und", "und", "und", 0.0)
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got.values())
    assert m.identify(none, model, carry=["doc_id"]).collect() == [] and m.learn(none).langs == []


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect())
    got = [r for r in m.op4_language_id(spark, data).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
