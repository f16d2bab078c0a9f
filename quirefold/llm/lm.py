"""Language-model scores by a weighted backoff automaton over the counts of the whole corpus.

States are the histories that were seen in training: the empty one, every token, and (at order 3) every pair. A state h
has an arc for each token w that was seen after it, with weight log10((c(hw) + MU p(w | h')) / (c(h) + MU)), where h' is h
without its first token; the arc leads to the longest history that ends there and is a state. Its failure arc leads to
h' with weight log10(MU / (c(h) + MU)). Of the empty history all tokens have arcs, by the base model. A text is read
once from left to right: each token follows failure arcs until there is an arc for it, and the state is carried on.
The conditional probabilities of every state sum to one.

No table of all n-grams fits anywhere, so each part of the corpus (about PART tokens) gets the piece of the
automaton that its texts can reach:
 1. a part is written as its distinct words' hashes and its texts as places in that list;
 2. every part sends its distinct words, pairs and triples, with their counts in its own training texts, to buckets by
    hash; a bucket adds up and answers each part with the totals that differ from the part's own counts;
 3. a part meets its answers, builds its states and arcs, and walks its texts.
A part sends each n-gram once, however often it has it, so frequent words are spread over the parts. The number of
buckets follows the number of tokens. Words are told apart by 64-bit hashes; longer n-grams by SPARE bits more than the
number of tokens has (64 at most), so at any size about one in 2^SPARE is taken for another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, give_back, remainder, table

#: Dirichlet mass of the shorter history, the base model's addend, and the order of the query's model.
MU, ADD, ORDER = 10.0, 0.1, 3
PART, PER_BUCKET, SPARE = 1_500_000, 1_000_000, 20
#: Tokens that a walk reads in one lane; the lanes of a part go side by side.
LANE = 256
END = np.uint64(0x5851F42D4C957F2D)
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORDS, PAIRS, TRIPLES = 0, 1, 2


class Hashes(dict):
    """64-bit hashes of words, those met last."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (v * MIX1) ^ (w << np.uint64(31) | w >> np.uint64(33)) * MIX2
    h ^= h >> np.uint64(32)
    h *= MIX1
    return h ^ h >> np.uint64(29)


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight beside each other, which compresses small numbers well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def narrow(a: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the largest needs, planes apart."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide(b: bytes) -> np.ndarray:
    part = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    full = np.zeros((part.shape[1], 8), np.uint8)
    full[:, : b[0]] = part.T
    return full.view("<i8").ravel()


def packed(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of as few bytes as the largest needs, bytes of equal weight beside each other; the
    highest, which are mostly small, compressed."""
    d = np.diff(sorted_hashes, prepend=np.uint64(0))
    first, d[:1] = d[:1].copy(), 0
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    rows = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = np.array([width, len(d)], np.uint32).tobytes()
    return head + first.tobytes() + rows[:-1].tobytes() + zstandard.compress(rows[-1].tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    width, n = map(int, np.frombuffer(b, np.uint32, 2))
    low = 16 + n * (width - 1)
    full = np.zeros((n, 8), np.uint8)
    full[:, : width - 1] = np.frombuffer(b[16:low], np.uint8).reshape(width - 1, n).T
    full[:, width - 1] = np.frombuffer(zstandard.decompress(b[low:]), np.uint8)
    d = full.view(np.uint64).ravel()
    d[:1] = np.frombuffer(b, np.uint64, 1, 8)
    return np.cumsum(d, dtype=np.uint64)


def counted(counts: np.ndarray, usual: int) -> bytes:
    """Counts that are not the usual one, as (place, count)."""
    at = np.flatnonzero(counts != usual)
    return np.concatenate([at.astype(np.int64), counts[at].astype(np.int64)]).tobytes()


def uncounted(b: bytes, n: int, usual: int) -> np.ndarray:
    both = np.frombuffer(b, np.int64).reshape(2, -1)
    out = np.full(n, usual, np.int64)
    out[both[0]] = both[1]
    return out


class Part:
    """The texts of one part: places in its list of words, ends included."""

    def __init__(self, vocab: bytes, seq: bytes, sizes, train):
        self.words = unplanes(vocab, np.uint64)  # by falling frequency
        self.seq = unplanes(seq, np.uint32).astype(np.int64)
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(np.asarray(train, bool), self.sizes)
        #: How many tokens of its text stand before each token.
        self.nth = np.arange(len(self.seq)) - np.repeat(self.starts, self.sizes)
        self.after = np.flatnonzero(self.nth)  # the first token of a text has no history

    def own_words(self) -> np.ndarray:
        return np.bincount(self.seq[self.train], minlength=len(self.words))

    def own_grams(self, order: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For pairs (and triples): the distinct hashes, sorted, of width bits; their training counts; each token's place among them (-1 without that much history)."""
        h = self.words[self.seq]
        whole, out = h, []
        for n in range(1, order):
            at = np.flatnonzero(self.nth >= n)
            longer = np.zeros(len(h), np.uint64)
            longer[at] = pair_hash(whole[at - 1], h[at])
            whole = longer
            distinct, place = np.unique(longer[at] >> np.uint64(64 - width), return_inverse=True)
            every = np.full(len(h), -1, np.int64)
            every[at] = place
            out.append((distinct, np.bincount(place[self.train[at]], minlength=len(distinct)), every))
        return out


def written_parts(df: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    id_type = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        held: list[np.ndarray] = []
        ids: list = []
        train: list[bool] = []
        total = 0

        def made() -> pd.DataFrame:
            words, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            sizes = [len(x) for x in held]
            return pd.DataFrame([{"part": uuid.uuid4().hex, "ids": ids, "train": train, "sizes": sizes, "vocab": planes(words[order]), "seq": planes(place[at]), "n_train": int(np.dot(sizes, train))}])

        for f in frames:
            for doc, text, learn in zip(f["id"].astype(object).where(f["id"].notna(), None), f["text"], f["train"], strict=True):
                w = text.encode().lower().split()  # of bytes: A-Z and the ASCII blanks only
                held.append(np.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), END))
                ids.append(doc), train.append(bool(learn))
                total += len(w) + 1
                if total >= PART:
                    yield made()
                    held, ids, train, total = [], [], [], 0
        if held:
            yield made()
        give_back()

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), train.alias("train"))
    return rows.mapInPandas(run, f"part string, ids array<{id_type}>, train array<boolean>, sizes array<long>, vocab binary, seq binary, n_train long")


def totals(parts: DataFrame, bits: int, order: int, width: int) -> DataFrame:
    """Answers (part, kind, bucket, which, counts): which of the hashes that the part sent to the bucket have other
    totals than the part's own counts, and these totals. With a null part: how many words of the bucket are in training."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                p = Part(row.vocab, row.seq, row.sizes, row.train)
                up = np.argsort(p.words)
                sent = [(p.words[up], p.own_words()[up], 64), *((h, n, width) for h, n, _ in p.own_grams(order, width))]
                for kind, (h, n, wide) in enumerate(sent):
                    bucket = (h >> np.uint64(wide - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                    names, first = np.unique(bucket, return_index=True)
                    cuts = [*first[1:], len(h)]
                    yield pd.DataFrame([{"bucket": int(b), "kind": kind, "part": row.part, "hashes": packed(h[s:e]), "counts": counted(n[s:e], 1)} for b, s, e in zip(names, first, cuts, strict=True)])
        give_back()

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket and kind."""
        now, rows = None, []

        def summed() -> Iterator[pd.DataFrame]:
            lists = [unpacked(r.hashes) for r in rows]
            own = [uncounted(r.counts, len(h), 1) for r, h in zip(rows, lists, strict=True)]
            names, at = np.unique(np.concatenate(lists), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(own)).astype(np.int64)
            lo = 0
            for r, h, n in zip(rows, lists, own, strict=True):
                s = sums[at[lo : lo + len(h)]]
                lo += len(h)
                differ = np.flatnonzero(s != n)
                if len(differ):
                    yield pd.DataFrame([{"part": r.part, "kind": r.kind, "bucket": r.bucket, "which": np.packbits(s != n).tobytes(), "counts": narrow(s[differ]), "distinct": 0}])
            if rows[0].kind == WORDS:
                yield pd.DataFrame([{"part": None, "kind": WORDS, "bucket": r.bucket, "which": None, "counts": None, "distinct": int((sums > 0).sum())}])

        for f in frames:
            for r in f.itertuples():
                if now != (r.bucket, r.kind):
                    if rows:
                        yield from summed()
                    now, rows = (r.bucket, r.kind), []
                rows.append(r)
        if rows:
            yield from summed()
        give_back()

    asked = parts.select("part", "vocab", "seq", "sizes", "train").mapInPandas(ask, "bucket long, kind int, part string, hashes binary, counts binary")
    return asked.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind", "part").mapInPandas(answer, "part string, kind int, bucket long, which binary, counts binary, distinct long")


class Automaton:
    """The states and arcs that the texts of one part can reach.

    States are numbers: 0 the empty history, then the part's words, then its pairs. Arcs are places among the part's
    words (from the empty history), pairs (from words) and triples (from pairs), since these are all that it can read.
    """

    def __init__(self, part: Part, answers, bits: int, n: int, v: int, mu: float = MU, order: int = 2, width: int = 64):
        self.part, seq = part, part.seq
        up = np.argsort(part.words)
        grams = part.own_grams(order, width)
        sent, held = [part.words[up], *(g[0] for g in grams)], [part.own_words(), *(g[1] for g in grams)]
        for kind, bucket, which, counts in answers:
            first = int(np.searchsorted(sent[kind], np.uint64(bucket << ((64 if kind == WORDS else width) - bits)))) if bits else 0
            at = first + np.flatnonzero(np.unpackbits(np.frombuffer(which, np.uint8)))
            held[kind][up[at] if kind == WORDS else at] = wide(counts)
        self.words, self.places = held[WORDS], [g[2] for g in grams]
        self.counts = held
        root = (self.words + ADD) / (n + ADD * (v + 1))
        #: By length of the history: weights of arcs by place, and whether there is one; failure weights by place of the history.
        self.arcs, self.there, self.failures = [np.log10(root)], [np.ones(len(root), bool)], [np.zeros(1)]
        below = root[seq]  # of each token its probability after the history that is shorter by one
        for k, place in enumerate(self.places):
            history = seq if k == 0 else self.places[k - 1]
            seen, before = held[k + 1], held[k]
            at = np.flatnonzero(place >= 0)
            context = before[history[at - 1]]
            p = (seen[place[at]] + mu * below[at]) / (context + mu)
            weight = np.zeros(len(seen))
            weight[place[at]] = np.log10(p)
            self.arcs.append(weight)
            self.there.append(seen > 0)
            self.failures.append(np.log10(mu / (before + mu)))
            below = below.copy()
            below[at] = p
        #: The last word of each pair, to which its failure arc leads.
        self.last = np.zeros(len(held[PAIRS]), np.int64) if grams else None
        if grams:
            self.last[self.places[0][part.after]] = seq[part.after]

    def walk(self) -> np.ndarray:
        """The weight of every token, read from left to right with the state carried on.

        Long texts go in lanes of LANE tokens; a lane that starts within a text reads the two tokens before it first,
        after which its state is that of the whole text.
        """
        part, seq = self.part, self.part.seq
        w, top = len(self.words), len(self.places)
        pieces = -(-part.sizes // LANE)
        text = np.repeat(np.arange(len(pieces)), pieces)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = part.starts[text] + piece * LANE
        stop = np.minimum(first + LANE, part.starts[text] + part.sizes[text])
        start = np.maximum(part.starts[text], first - 2)
        by = np.argsort(start - stop, kind="stable")  # longest lanes first
        first, stop, at = first[by], stop[by], start[by]
        state, out = np.zeros(len(at), np.int64), np.zeros(len(seq))
        alive = len(at)
        while True:
            while alive and at[alive - 1] >= stop[alive - 1]:
                alive -= 1
            if not alive:
                return out
            pos, s, cost = at[:alive], state[:alive], np.zeros(alive)
            token = seq[pos]
            pair = self.places[0][pos] if top else None
            done = np.zeros(alive, bool)
            if top > 1:  # arcs of pairs
                two = s > w
                three = np.where(two, self.places[1][pos], 0)
                done = two & self.there[2][three]
                cost[done] = self.arcs[2][three[done]]
                fail = two & ~done
                cost[fail] += self.failures[2][s[fail] - w - 1]
                s = np.where(fail, 1 + self.last[np.where(fail, s - w - 1, 0)], s)
            if top:  # arcs of words
                one = (s > 0) & ~done
                two = np.where(one, pair, 0)
                found = one & self.there[1][two]
                cost[found] += self.arcs[1][two[found]]
                fail = one & ~found
                cost[fail] += self.failures[1][s[fail] - 1]
                done = done | found
            left = ~done
            cost[left] += self.arcs[0][token[left]]
            known = np.where(self.words[token] > 0, 1 + token, 0)
            state[:alive] = np.where(done & (top > 1), 1 + w + pair, known) if top else known
            kept = pos >= first[:alive]
            out[pos[kept]] = cost[kept]
            at[:alive] += 1

    def scores(self) -> dict[str, np.ndarray]:
        s = self.part
        add = lambda x: np.add.reduceat(x, s.starts)
        return {"n_tokens": s.sizes, "n_known": add((self.words[s.seq] > 0).astype(np.int64)), "base_score": add(self.arcs[0][s.seq]), "score": add(self.walk())}


def score_documents(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, order: int = 2) -> DataFrame:
    """One row per row of df: id, trained, n_tokens, n_known, train_tokens, base_score and score, by n-grams up to order (2 or 3).

    train says which rows the model learns from (null: not). A null text counts as empty: its only token is the
    end. Ids are carried along only, so null and repeated ones are scored like any other. Without training rows
    every token is unknown. An empty table gives an empty result. Other columns play no part, whatever their names.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    id_type = dict(df.dtypes)[id_col]
    parts = scratch.write(written_parts(df, id_col, text_col, F.coalesce(train, F.lit(False))))
    n, every = parts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    bits = max(0, (every // PER_BUCKET).bit_length())
    width = min(64, every.bit_length() + SPARE)
    answers = scratch.write(totals(parts, bits, order, width))
    v = answers.filter("part is null").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=columns)
        row = left.iloc[0]
        part = Part(row["vocab"], row["seq"], row["sizes"], row["train"])
        got = Automaton(part, zip(right["kind"], right["bucket"], right["which"], right["counts"], strict=True), bits, n, v, mu, order, width).scores()
        give_back()
        return pd.DataFrame({"id": pd.Series(list(row["ids"]), dtype=object), "trained": row["train"], **got, "train_tokens": n})[columns]

    columns = ["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    shape = f"id {id_type}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = parts.groupBy("part").cogroup(answers.filter("part is not null").select("part", "kind", "bucket", "which", "counts").groupBy("part")).applyInPandas(run, shape)
    return scored.withColumnRenamed("id", id_col)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by n-grams up to ORDER, learnt from those whose id leaves a remainder by 10 (see score_documents for odd rows)."""
    scored = score_documents(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0, order=ORDER)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
