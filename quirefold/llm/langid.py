"""Language identification by a string kernel.

Texts are compared by the n-grams (one to three characters, blended spectrum) that both hold, whatever their
number: k(x, z) = |x and z| / sqrt(|x| |z|). Nystroem landmarks turn the kernel into features, and kernel ridge
regression learns one language against the rest on them. n-grams are hashed into 65,536 places, so a batch of
texts is a 0/1 matrix; its product with the landmarks' matrix is linear in the former, and the two products are
multiplied out once, after fitting.

The model is fitted on the driver on at most PER_LANGUAGE documents, of SAMPLE_BYTES bytes in all, of each language,
picked by a hash of the id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import mapped, remainder, table

PER_LANGUAGE, SAMPLE_BYTES, LANDMARKS, RIDGE, BITS, BATCH = 600, 16_000_000, 60, 0.05, 16, 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """The distinct places of the 1- to 3-grams of the text in lower case."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    held = np.zeros(1 << BITS, bool)
    two = c[:-1] << np.uint64(21) | c[1:]
    for g in (c + np.uint64(1 << 63), two, (two[:-1] << np.uint64(21) | c[2:]) + np.uint64(7)):
        h = g * MIX
        held[((h ^ h >> np.uint64(29)) * MIX >> np.uint64(64 - BITS)).astype(np.intp)] = True
    return np.flatnonzero(held)


def presence(sets: list[np.ndarray]) -> np.ndarray:
    """One row per text, its n-grams as ones over the root of their number."""
    m = np.zeros((len(sets), 1 << BITS), np.float32)
    for row, s in zip(m, sets, strict=True):
        row[s] = 1 / np.sqrt(max(1, len(s)))
    return m


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        if not self.langs:
            self.weights, self.bias = np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
            return
        sets = [grams(t) for t in texts]
        at = {lang: [i for i, x in enumerate(langs) if x == lang][:landmarks] for lang in self.langs}
        marks = presence([sets[i] for own in at.values() for i in own])
        kernel = (marks @ marks.T).astype(float)
        val, vec = np.linalg.eigh(kernel)
        root = vec / np.sqrt(np.maximum(val, 1e-4)) @ vec.T
        to_marks = np.concatenate([presence(sets[i : i + BATCH]) @ marks.T for i in range(0, len(sets), BATCH)]).astype(float)
        x = np.c_[to_marks @ root, np.ones(len(sets))]
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        share = np.array([1 / langs.count(lang) for lang in langs])[:, None]
        w = np.linalg.solve(x.T @ (x * share) + RIDGE / x.shape[1] * np.eye(x.shape[1]), x.T @ (y * share))
        self.weights = (marks.T @ (root @ w[:-1]).astype(np.float32)).astype(np.float32)
        self.bias = w[-1]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for lo in range(0, len(texts), BATCH):
            part = texts[lo : lo + BATCH]
            s = presence([grams(t) for t in part]) @ self.weights + self.bias
            for t, row in zip(part, s, strict=True):
                if not self.langs or not any(map(str.isalpha, t)):
                    out.append(("und", 0.0))
                else:
                    k = int(row.argmax())
                    out.append((self.langs[k], float(min(1.0, max(0.0, (row[k] + 1) / 2)))))
        return out


def learn(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on rows with text and language: of each language at most per_language ids, those that hash lowest, and at
    most sample_bytes of text.

    Of rows that repeat an id in one language the least text counts. A table without such rows gives a model that
    knows no language. Other columns play no part.
    """
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("t is not null and l is not null")
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy("l").agg(F.approx_count_distinct("id")).collect()}  # one row per language
    if not counts:
        return Model([], [])
    # a hash below this share picks about twice as many rows as are wanted, of which the lowest are taken
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2 * per_language + 100) / n))])
    h = F.xxhash64(F.col("id").cast("string"))
    place = F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))
    own = W.partitionBy("l").orderBy("place", "h")
    picked = (
        rows.withColumn("h", h).withColumn("place", place).filter(F.col("place") < share[F.col("l")]).groupBy("l", "h", "place").agg(F.min("t").alias("t"))
        .withColumn("nth", F.row_number().over(own)).withColumn("so_far", F.sum(F.octet_length("t")).over(own))
        .filter((F.col("nth") <= per_language) & (F.col("so_far") <= sample_bytes)).select("l", "t").toPandas()
    )
    picked = picked.sort_values(["l", "t"]).sample(frac=1, random_state=1)
    return Model(picked["t"].tolist(), picked["l"].tolist())


def identify(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default), lang_pred and score (0 to 1).

    A null text, and one without a letter, is `und` with score 0. Texts are taken whole, each by itself, so ties
    between languages go to the first by name, repeats are alike and an empty table gives an empty result. Carried
    columns may have any names; one that bears the name of a result gives way to it.
    """

    def make(texts: list) -> list[list]:
        found = model.predict([t or "" for t in texts])
        return [[x[0] for x in found], [x[1] for x in found]]

    return mapped(df, carry or df.columns, text_col, "lang_pred string, score double", make)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose id leaves no remainder 2 by 4 (see learn and identify for odd rows)."""
    docs = table(spark, sf_dir, "documents")
    out = remainder(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~out))
    return identify(docs, model, carry=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")
