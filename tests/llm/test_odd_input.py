"""Columns of any name beside those that the operators read, very long texts, repeated ids, lines that many texts share."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from quirefold.llm import bpe, exact_dedup, html_extract, langid, lm, media, near_copies, packing, pii, simhash, toxicity
from quirefold.llm._common import remainder

from .conftest import ROWS

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Names that the operators use for themselves or give to their results, and one that needs quoting.
NAMES = (
    "row rid id grp sha bytes run salt n over rest spelt ended kept Fp fp_ _text _scored _html _ids digest made first settled carried value none text_ ids decoded n_tokens SCORE Predicted "
    "passages keep_id group_size TEXT_SHA256 component_id fingerprint node root comp key cell media rgb feature entities lang_pred html piece start length sequence_id offset a.b train part"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(r[0], r[1], r[2], *range(len(NAMES))) for r in ROWS]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(2).cache()


def test_columns_of_any_name(clashing):
    d, model = clashing, toxicity.Model()
    lang = langid.Model(["ein Text"], ["de"])
    results = {
        "exact_dedup": (exact_dedup.exact_dedup(d, carry=d.columns), {"keep_id", "group_size", "kept", "text_sha256"}),
        "score": (toxicity.score(d, model, carry=d.columns), {"score", "predicted", "passages"}),
        "identify": (langid.identify(d, lang), {"lang_pred", "score"}),
        "bpe_encode": (bpe.bpe_encode(d, RANKS), {"ids"}),
        "bpe_decode": (bpe.bpe_decode(bpe.bpe_encode(d, RANKS), RANKS), {"ids", "decoded"}),
        "fingerprints": (simhash.fingerprints(d), {"fp"}),
        "media_columns": (media.media_columns(d), {f.split()[0] for f in (media.FIELDS + ", " + media.COLUMNS).split(", ")}),
        "extract": (html_extract.extract(d, html_col="text"), {"text", "n_chars"}),
        "replace_pii": (pii.replace_pii(d), {"entities"}),
        "replaced_by_join": (pii.replace_pii(d, lookup=-1), {"entities"}),
    }
    for name, (out, own) in results.items():
        want = {x for x in d.columns if x.lower() not in own} | own
        assert set(out.columns) == want and len(out.columns) == len(want), name
        got = out.collect()
        assert len(got) == len(ROWS), name
        for i, n in enumerate(NAMES):
            assert n.lower() in own or all(r[n] == i for r in got), (name, n)
    for out in (simhash.simhash_groups(d), lm.score_documents(d, F.lit(True)), packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"))):
        assert out.count() >= len(ROWS)
    for out in (simhash.near_dedup(d), near_copies.drop_near_copies(d)):
        assert out.columns == d.columns and 0 < out.count() < len(ROWS)


def test_stages_with_columns_of_any_name(clashing, none, spark):
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, clashing, "/root/testdata/sf0.001")
        assert out.columns == clashing.columns and 0 < out.count() <= len(ROWS), name
    assert c.pack_sequences(spark, clashing, "").count() >= len(ROWS)
    assert c.pack_sequences(spark, none, "").count() == 0


def test_long_copies(spark):
    """Three equal texts of 50 million bytes, one that differs in its last byte, and one that ends before."""
    def made(frames):
        for f in frames:
            short = "0123456789" * 4_999_999
            f["text"] = [short + ("0123456789" if i < 3 else "012345678x" if i == 3 else "") for i in f["id"]]
            yield f

    df = spark.range(5, numPartitions=5).mapInPandas(made, "id long, text string")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, "id").collect()}
    assert got == {0: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), 4: (4, 1, True)}


def test_large_groups_of_copies(spark, monkeypatch):
    """Summaries go to several places once a group is large."""
    monkeypatch.setattr(exact_dedup, "SHARE", 7)
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(300)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (299, 200, i == 299) if i % 3 else (i, 1, True) for i, _ in rows}


def test_a_shared_line_costs_no_text():
    texts = ["All of these begin with one line that they share.\n" + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(400)]
    kept, labels = toxicity.apart(texts + [texts[0] + " more"], [i % 2 for i in range(401)])
    assert kept == texts and len(labels) == 400


def test_samples_hold_repeated_ids(spark, monkeypatch):
    """However often an id is repeated, no more documents are fitted on than the sample has."""
    docs = spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen = []
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, texts, y: seen.append(len(texts)) or self)
    toxicity.learn(docs, labels, sample=10)
    toxicity.learn(docs, labels, sample=10, sample_bytes=40)
    assert seen == [20, 4]
    monkeypatch.setattr(langid.Model, "__init__", lambda self, texts, langs: seen.append(len(texts)))
    langid.learn(docs, per_language=12)
    assert seen[2] == 12


def test_scores_against_the_model_itself(spark):
    """op10's scores are those of the plain model, text by text."""
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.op10_toxicity(spark, data).collect()}
    for r in docs.collect():
        words = toxicity.WORD.findall((r.text or "").lower())
        scores = [model.score(w) for w in words]
        # every maximal segment by its definition: the best one, then what lies to its left and right
        todo, found = [(0, len(words))], []
        while todo:
            lo, hi = todo.pop()
            best, run, start, span = 1e-9, 0.0, lo, None
            for i in range(lo, hi):
                if run <= 0:
                    run, start = 0.0, i
                run += scores[i]
                if run > best:
                    best, span = run, (start, i)
            if span:
                found.append((*span, best))
                todo += [(lo, span[0]), (span[1] + 1, hi)]
        want = model.probability(model.evidence(len(words), found))
        assert got[r.doc_id][0] == pytest.approx(want, abs=1e-6) and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.7)
