"""Near copies by the Jaccard similarity of their word shingles, found by SimHash and Golay-code fuzzy hashing.

A text's SimHash over its shingles has as many segments of 23 bits as needed. The key of a segment is the index of the
codeword of the perfect Golay code nearest to it. At a similarity of 0.8 two texts differ in 15 % of their bits and have
the same index of one segment with probability 0.12, so of such pairs one in 10,000 (MISS) shares no key of 72; of nearer
pairs fewer. With many texts a key has more bits (and there are more segments), so that keys stay as selective.

Of the texts that share a key only those are linked whose first 192 bits differ in at most 60 (DISTANCE): by the
binomial law unrelated texts do so with probability 1e-7, and pairs at 0.8, which differ in 29, miss it with less. What
these links join is one group. The first FIRST segments join most of it, so that the others add few links.

Every link is checked on the shingles themselves, and each text is in one group only. A group is dealt into lots of
bounded size that have a few of its texts (PIVOTS) in common, which settles most. Where several components are left,
cells of bounded size compare the texts outside the largest with all others: n texts with s outside make about
n + 2 * n * s / CELL rows, so a group whose texts are linked makes as many rows as it has texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch
from .components import components
from .simhash import codeword_index

WORDS, SIMILARITY, SEED, CELL = 5, 0.8, 42, 256
#: Bits of a segment, and of the fingerprint's head with the most that may differ there; texts that a key is meant for, and most that are compared in one step.
SEGMENT, HEAD, DISTANCE, CROWD, MOST = 23, 3, 60, 256, 1024
#: Segments whose keys come first; texts that all lots of a group have in common.
FIRST, PIVOTS = 8, 16
#: Of pairs at a similarity of 0.8: that share no key; that have the same index of a segment; that differ in a bit.
MISS, MEET, DIFFER = 1e-4, 0.1213, 0.1515


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of the shingles, sorted; a shorter text is one shingle, a text without words none."""
    w = text.encode().lower().split()  # of bytes: A-Z and the ASCII blanks only
    if not w:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in parts]), ">u8").astype(np.uint64))


def scheme(n: int) -> tuple[int, int]:
    """For n texts: bits of a key beyond the codeword's 12, and the number of segments."""
    extra = max(0, math.ceil(math.log2(max(n, 1) / CROWD)) - 12)
    return extra, math.ceil(math.log(MISS) / math.log(1 - MEET * (1 - DIFFER) ** extra))


def simhash(hashes: np.ndarray, size: int) -> np.ndarray:
    """That many bits, at least, of whole words of 64; a bit is 1 if set in over half the hashes' derivates."""
    random = np.random.default_rng(SEED)
    factors, shifts = (random.integers(0, 2**64, -(-size // 64), dtype=np.uint64) for _ in range(2))
    ones = np.zeros(64 * len(factors), np.int64)
    for lo in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[lo : lo + 255, None] * (factors | np.uint64(1)) + shifts
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return ones * 2 > len(hashes)


def bands(bits: np.ndarray, extra: int = 0, n: int | None = None) -> np.ndarray:
    """Keys of fingerprints (a row of bits each), one column a segment: its number, its Golay index, its further bits."""
    wide = SEGMENT + extra
    n = bits.shape[1] // wide if n is None else n
    parts = bits[:, : n * wide].reshape(len(bits), n, wide)
    word = parts[:, :, :SEGMENT] @ (1 << np.arange(SEGMENT, dtype=np.uint32))
    more = parts[:, :, SEGMENT:] @ (1 << np.arange(extra, dtype=np.int64))
    return (np.arange(n) << 12 | codeword_index(word.astype(np.uint32)).astype(np.int64)) << extra | more


def clusters(heads: np.ndarray, most: int = MOST) -> np.ndarray:
    """For each of these heads (rows of words) the place of the first that it is joined to by links of DISTANCE bits."""
    root = np.arange(len(heads))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    pairs = None
    if len(heads) <= most:
        apart = sum(np.bitwise_count(heads[:, None, k] ^ heads[None, :, k]).astype(np.uint8) for k in range(HEAD))
        pairs = np.argwhere(np.triu(apart <= DISTANCE, 1))
    if pairs is None or len(pairs) > 2 * len(heads):
        pairs, left = [], np.arange(len(heads))
        while len(left):  # each compared with those not yet reached
            front, left = [left[0]], left[1:]
            while front and len(left):
                a = front.pop()
                hit = np.bitwise_count(heads[left] ^ heads[a]).sum(1, dtype=np.int64) <= DISTANCE
                pairs += [(a, b) for b in left[hit]]
                front += list(left[hit])
                left = left[~hit]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return np.array([find(i) for i in root], np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; empty sets are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def joining(sets: list[np.ndarray], comps: list, similarity: float) -> list[tuple[int, int]]:
    """Links (pairs of places) that join what pairs of these sets join, besides the components that are known."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, code = np.unique(every, return_inverse=True)
    ends = np.cumsum(sizes)
    codes = np.split(code, ends[:-1])
    mark = np.zeros(len(every) + 1, bool)
    of: dict = {}
    for i, c in enumerate(comps):
        of.setdefault(c, []).append(i)
    out = []
    while len(of) > 1:
        front = of.pop(next(iter(of)))
        while front and of:
            a = front.pop()
            mark[codes[a]] = True
            for c in list(of):
                for b in of[c]:
                    if min(sizes[a], sizes[b]) < similarity * max(sizes[a], sizes[b]) - 1e-9:
                        continue
                    common = np.count_nonzero(mark[codes[b]])
                    if common >= similarity * (sizes[a] + sizes[b] - common) - 1e-9:
                        out.append((a, b))
                        front += of.pop(c)
                        break
            mark[codes[a]] = False
    return out


def _signed(df: DataFrame, words: int, size: int = 64 * HEAD) -> DataFrame:
    """id, node (128 bits of the text's SHA-256) and print (the SimHash) of rows (id, text)."""
    kept = df.select("id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("node"), "text")
    shape = T.StructType([*kept.schema.fields[:-1], T.StructField("print", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.packbits(simhash(shingles(t, words), size)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=["id", "node", "print"])

    return kept.mapInArrow(run, shape)


_HEAD = [f"h{k}" for k in range(HEAD)]
_HEADS = ", ".join(f"{h} long" for h in _HEAD)


def _linked(prints: DataFrame, extra: int, n: int, lo: int, hi: int) -> DataFrame:
    """Links (u, v) between the components that keys of the segments lo to hi join, of prints (print, heads, comp).

    The texts of a key are rows of one task, however many they are; each meets those that are not yet reached.
    """
    most = MOST

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(len(part), -1), axis=1)
                keys = bands(bits, extra, n)[:, lo:hi]
                rest = [pa.array(np.repeat(part.column(k + 1).to_numpy(), hi - lo)) for k in range(1 + HEAD)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *rest], names=["key", "comp", *_HEAD])

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key, the least component first; a key may go on in the next frame."""

        def done(rows: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            ends, out = np.r_[starts[1:], len(rows)], [np.zeros((0, 2), np.int64)]
            for s, e in zip(starts, ends, strict=True):
                comp = rows[s:e, 1]
                if e - s > 1 and (comp != comp[0]).any():
                    first = comp[clusters(np.ascontiguousarray(rows[s:e, 2:]).view(np.uint64), most)]
                    out.append(np.c_[comp, first][comp != first])
            return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])

        rest: list[np.ndarray] = []
        for f in frames:
            rows = f.to_numpy(np.int64)
            same = rows[:, 0] == rows[-1, 0]
            if rest and same.all() and rest[-1][-1, 0] == rows[0, 0]:
                rest.append(rows)
                continue
            rows = np.concatenate([*rest, rows])
            last = int(np.flatnonzero(rows[:, 0] != rows[-1, 0]).max(initial=-1)) + 1
            rest = [rows[last:]]
            if last:
                yield done(rows[:last])
        if rest:
            yield done(np.concatenate(rest))

    dealt = prints.select("print", "comp", *_HEAD).mapInArrow(emit, f"key long, comp long, {_HEADS}")
    return dealt.repartition("key").sortWithinPartitions("key", "comp").mapInPandas(joined, "u long, v long")


def _keyed(signed: DataFrame, extra: int, n: int) -> DataFrame:
    """(node, keys) of all texts; the key, one for each text, names the group that the links of heads join."""
    scratch = Scratch(signed.sparkSession, "near-copies-prints")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1)
            heads = np.ascontiguousarray(raw[:, : 8 * HEAD]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(heads[:, k]) for k in range(HEAD))], names=["node", "print", *_HEAD])

    prints = scratch.write(
        signed.select("node", "print").dropDuplicates(["node"]).mapInArrow(words, f"node binary, print binary, {_HEADS}")
        .withColumn("comp", F.xxhash64(*_HEAD))  # texts that differ may have one head, and are one group then
    )
    own = prints.dropDuplicates(["print"])

    def rooted(df: DataFrame, links: DataFrame) -> DataFrame:
        roots = scratch.write(components(links)).select(F.col("node").alias("comp"), "root")
        return df.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")

    prints = scratch.write(rooted(prints, _linked(own, extra, n, 0, FIRST)))
    more = _linked(prints.dropDuplicates(["print"]), extra, n, FIRST, n)
    return rooted(prints, more).select("node", F.array("comp").alias("keys"))


def _across(cells: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (u, v) between components in cells (key, cell, comp, text)."""

    def done(f: pd.DataFrame) -> pd.DataFrame:
        got = joining([shingles(t, words) for t in f["text"]], f["comp"].tolist(), similarity)
        comps = f["comp"].tolist()
        return pd.DataFrame({"u": [comps[a] for a, _ in got], "v": [comps[b] for _, b in got]}, columns=["u", "v"])

    return cells.groupBy("key", "cell").applyInPandas(done, "u binary, v binary")


def groups(rows: DataFrame, signed: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every text (node, text in rows) that has a near copy; texts (node, keys in signed) are compared
    with all that share a key."""
    scratch = Scratch(signed.sparkSession, "near-copies-bands")
    keyed = signed.select(F.explode("keys").alias("key"), "node").distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("k", F.ceil(F.col("n") / CELL))
    members = scratch.write(keyed.join(shared, "key"))
    texts = scratch.write(rows.join(members.select("node").distinct(), "node", "left_semi").select("node", "text").dropDuplicates(["node"]))
    lot = F.expr("pmod(xxhash64(node), k)")
    pivot = F.expr(f"k > 1 and pmod(xxhash64(node, 1), ceil(n / {PIVOTS})) = 0")
    lots = members.select("key", "node", F.col("node").alias("comp"), F.explode(F.when(pivot, F.expr("sequence(0L, k - 1)")).otherwise(F.array(lot))).alias("cell"))
    roots = scratch.write(components(_across(lots.join(texts, "node").drop("node"), words, similarity)))
    # texts of one lot have been compared
    now = members.filter("k > 1").join(roots, "node", "left").select("key", "node", "n", "k", F.coalesce("root", "node").alias("comp"))
    several = (
        now.groupBy("key", "n", "comp").agg(F.count("*").alias("m")).groupBy("key", "n").agg(F.max(F.struct("m", "comp")).alias("most"))
        .filter("most.m < n").select("key", F.col("most.comp").alias("most"), F.ceil((F.col("n") - F.col("most.m")) / CELL).alias("lines"))
    )
    # a text outside the largest component has a line of cells, every text a column of them, so that the former meet all
    line = F.expr("transform(sequence(0L, k - 1), j -> pmod(xxhash64(node), lines) * k + j)")
    column = F.expr("transform(sequence(0L, lines - 1), i -> i * k + pmod(xxhash64(node), k))")
    cells = (
        now.join(several, "key")
        .select("key", "node", "comp", F.explode(F.when(F.col("comp") == F.col("most"), column).otherwise(F.array_union(line, column))).alias("cell"))
    )
    last = scratch.write(components(_across(cells.join(texts, "node").drop("node"), words, similarity)))
    moved = roots.join(last.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return moved.unionByName(last.join(roots, "node", "left_anti"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df without near copies: of each group of texts linked by that similarity the row with the least id
    stays, and one only.

    All columns are kept, whatever their names. Rows with a null id come first; repeated rows count as one. Null texts
    count as empty, and texts without words are equal.
    """
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scratch = Scratch(df.sparkSession, "near-copies")
    extra, n = scheme(df.count())
    signed = scratch.write(_signed(rows, words, n * (SEGMENT + extra)))
    rows = rows.withColumn("node", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    roots = groups(rows, scratch.write(_keyed(signed, extra, n)), words, similarity)
    chosen = (
        signed.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("comp")).agg(F.min(F.struct("id", "node")).alias("best"))
        .select(F.col("best.node").alias("node"), F.col("best.id").alias("best_id"))
    )
    kept = rows.select("row", "id", "node").join(chosen, "node").filter(F.col("id").eqNullSafe(F.col("best_id")))
    return kept.dropDuplicates(["node"]).select("row.*")
