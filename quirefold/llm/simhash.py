"""SimHash near-duplicates by Golay-code fuzzy hashing.

The fingerprint is cut into four segments of 16 bits. At three differing bits or fewer (pigeonhole) either two
segments are equal, or one is equal and each of the others differs in one bit. In the first case the two segments
are the key. In the second, a segment is hashed by the perfect binary Golay code: its own index is that of the
codeword nearest to it (padded to 23 bits), its near ones are those of all words one bit away; the key is the
equal segment with the near indices of one and the own index of another segment, or the other way round, and two
fingerprints that differ in one bit in each of these share such a key in opposite roles. A key has 32 to 40 bits,
so unrelated fingerprints seldom share one.

Equal fingerprints are one node. Keys that only one fingerprint has are dropped by a join with their counts, and a
key that many share is cut into a grid of cells of bounded size. A cell compares all of its fingerprints exactly
but emits only a spanning forest of their links, so no cell emits more rows than it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, mapped, table
from .components import components

WORDS, DISTANCE, SEED, CELL = 3, 3, 42, 1024
SEGMENT = 16
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the (23, 12) Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits; a bit is 1 if set in over half the shingles' XXH64. A text without words has fingerprint 0."""
    w = text.encode().lower().split()  # of bytes: A-Z and the ASCII blanks only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[lo : lo + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """The carried columns (all by default) and fp, the fingerprint as a signed long.

    Null texts count as empty, repeated rows are alike, and an empty table gives an empty result. Carried columns may
    have any names; one named fp, in whatever case, gives way to the result.
    """

    def make(texts: list) -> list[list]:
        return [np.array([fingerprint(t or "", words) for t in texts], np.uint64).view(np.int64).tolist()]

    return mapped(df, carry or df.columns, text_col, "fp long", make)


@cache
def _nearest() -> np.ndarray:
    """The error pattern of each of the 2,048 syndromes: the code is perfect, so each has one of three bits at most."""
    out = np.zeros(2048, np.uint32)
    units = [_residue(1 << i) for i in range(23)]
    for a in range(23):
        out[units[a]] = 1 << a
        for b in range(a):
            out[units[a] ^ units[b]] = 1 << a | 1 << b
            for c in range(b):
                out[units[a] ^ units[b] ^ units[c]] = 1 << a | 1 << b | 1 << c
    return out


def _residue(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _residues() -> np.ndarray:
    return np.array([[_residue(b << s) if b << s < 1 << 23 else 0 for b in range(256)] for s in (0, 8, 16)], np.uint32)


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    r = _residues()
    syndrome = r[0][words & 255] ^ r[1][words >> 8 & 255] ^ r[2][words >> 16]
    return (words ^ _nearest()[syndrome]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, role, key) of every key of the fingerprints; equal segments have role 2, near and own indices 0, own and near ones 1."""
    rows = np.arange(len(fps), dtype=np.int64)
    seg = [(fps >> np.uint64(SEGMENT * i) & np.uint64(0xFFFF)).astype(np.uint32) for i in range(4)]
    flips = np.array([0, *(1 << i for i in range(SEGMENT))], np.uint32)
    own = [codeword_index(w).astype(np.int64) for w in seg]
    near = [np.unique((rows[:, None] << 12 | codeword_index(w[:, None] ^ flips[None, :]).astype(np.int64)).ravel()) for w in seg]
    out = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        out.append((rows, np.full(len(rows), 2, np.int8), n << 40 | seg[i].astype(np.int64) << 16 | seg[j]))
    for same in range(4):
        i, j = [x for x in range(4) if x != same][:2]
        for role, (x, y) in enumerate(((i, j), (j, i))):
            row, index = near[x] >> 12, near[x] & 4095
            both = (index << 12 | own[y][row]) if role == 0 else (own[y][row] << 12 | index)
            out.append((row, np.full(len(row), role, np.int8), (6 + same) << 40 | seg[same].astype(np.int64)[row] << 24 | both))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the links among these fingerprints, each compared with those not yet reached."""
    left, out = np.arange(len(fps)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            a = front.pop()
            hit = np.bitwise_count(fps[left] ^ fps[a]) <= distance
            out += [(int(a), int(b)) for b in left[hit]]
            front += list(left[hit])
            left = left[~hit]
    return out


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell; a cell may go on in the next frame."""
    rest = None

    def done(cell: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        u, v = [], []
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
        ends = np.r_[starts[1:], len(cell)]
        two = starts[ends - starts == 2]
        hit = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE]
        u.append(fps[hit]), v.append(fps[hit + 1])
        many = ends - starts > 2
        for s, e in zip(starts[many], ends[many], strict=True):
            own = np.unique(fps[s:e])
            pairs = np.array(forest(own), np.int64).reshape(-1, 2).T
            u.append(own[pairs[0]]), v.append(own[pairs[1]])
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        f = pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})
        return f[f["u"] != f["v"]].drop_duplicates()

    for f in frames:
        cell, fps = f[["key", "cell"]].to_numpy(np.int64), f["fp"].to_numpy(np.int64).view(np.uint64)
        if rest is not None:
            cell, fps = np.concatenate([rest[0], cell]), np.concatenate([rest[1], fps])
        last = int(np.flatnonzero((cell != cell[-1]).any(1)).max(initial=-1)) + 1
        rest = cell[last:], fps[last:]
        if last:
            yield done(cell[:last], fps[:last])
    if rest is not None and len(rest[0]):
        yield done(*rest)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that join what three differing bits join, of a table of distinct fingerprints fp."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for lo in range(0, len(fps), 2000):
                part = fps[lo : lo + 2000]
                row, role, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(part[row])], names=["key", "role", "fp"])

    keyed = distinct.select("fp").mapInArrow(emit, "key long, role byte, fp long")
    shared = (
        keyed.groupBy("key")
        .agg(F.count_if(F.col("role") != 1).alias("a"), F.count_if(F.col("role") != 0).alias("b"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        .filter("lo < hi").select("key", F.ceil(F.col("a") / CELL).cast("int").alias("na"), F.ceil(F.col("b") / CELL).cast("int").alias("nb"))
    )
    # a grid of na x nb cells: rows of role 0 have a line of their own and go to all its cells, those of role 1 a column
    line = F.expr("transform(sequence(0, nb - 1), j -> pmod(xxhash64(fp), na) * nb + j)")
    column = F.expr("transform(sequence(0, na - 1), i -> i * nb + pmod(xxhash64(fp), nb))")
    cells = (
        # a row of distinct makes some 45 of keyed, which Spark's size estimate does not know: never broadcast by it
        keyed.join(shared.hint("merge"), "key")
        .select("key", F.explode(F.when(F.col("role") == 0, line).when(F.col("role") == 1, column).otherwise(F.array_union(line, column))).alias("cell"), "fp")
    )
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInPandas(_links, "u long, v long")


def near_groups(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fp, comp (a fingerprint of its component, the same for all of it) and component_id (the component's least id,
    null if all its ids are null) of every distinct fingerprint."""
    scratch = Scratch(prints.sparkSession, "simhash")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return named.join(least, "comp").select("fp", "comp", "component_id")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, fingerprint (16 hex digits) and component_id.

    Null and wordless texts have fingerprint 0 and are linked like any other; equal fingerprints are always linked.
    Null ids are no component's name unless a component has no other; repeated rows give repeated rows. An empty
    table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "simhash-docs")
    prints = scratch.write(fingerprints(df, text_col, [id_col]))
    groups = near_groups(prints, id_col)
    # repeated fingerprints are stored in far fewer bytes than they take in memory
    return prints.hint("merge").join(groups, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each group the row with the least id stays, and one only.

    All columns are kept, whatever their names. Rows with a null id come first; repeated rows count as one.
    """
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = Scratch(df.sparkSession, "simhash-docs").write(fingerprints(rows, "text", ["id"]))
    chosen = (
        prints.join(near_groups(prints, "id"), "fp").groupBy("comp").agg(F.min(F.struct("id", "fp")).alias("best"))
        .select(F.col("best.id").alias("best_id"), F.col("best.fp").alias("best_fp"))
    )
    both = fingerprints(rows, "text", ["row", "id"])
    kept = both.join(chosen, (both["fp"] == chosen["best_fp"]) & both["id"].eqNullSafe(chosen["best_id"]))
    return kept.dropDuplicates(["best_fp", "best_id"]).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (see simhash_groups for odd rows)."""
    return simhash_groups(table(spark, sf_dir, "documents"))
