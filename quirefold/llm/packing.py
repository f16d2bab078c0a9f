"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task keeps a fixed number of open sequences in a bitset keyed by free space: bit f of one integer says that
some open sequence has f places left, so the tightest fit is one shift and one find-first-set. When a new
sequence is needed and all are open, the fullest closes. Pieces reach the tasks by a hash of document and piece
and come in lots, in the order of that hash, so a task that is run again packs the same way, and one source or
document that holds much of the table is dealt evenly. A lot has fewer pieces than sequences may be open and comes
longest first, so short pieces follow the long ones before the space beside these is lost, however large a task is.
Only piece lengths are shuffled, unless the ids are asked for.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

CAPACITY, OPEN_BINS, END_ID = 2048, 65_536, 0
#: Runs of this many letters or blanks go to the tokenizer whose merges are not quadratic in them.
LONG_RUN = re.compile(r"\S{600}|\s{600}")
_encoders: dict = {}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    Where the file's merges are in the order of their ids, the same ids come several times faster from the
    tiktoken library over the same vocabulary; texts with very long runs, and other files, use tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Tokens that stand in a text by name, which the library finds before anything else.
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        import public_tokenizers
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        # the library's own spelling of the 256 bytes, read off characters that hold each byte
        spelt = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True)}
        rest = [b for b in range(256) if b not in spelt]
        spelt |= {256 + i: b for i, b in enumerate(rest)}
        if {chr(c) for c in spelt} != set(ByteLevel.alphabet()):
            raise ValueError("the library spells bytes in another way")
        ranks = {bytes(spelt[ord(c)] for c in tok): i for tok, i in vocab.items() if tok not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids):
            return None
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_RUN.search(text) or any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class BestFit:
    """Online best fit over a bounded number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item of 1 to capacity places, and its offset there."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            k = self._take(room)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            k, room = self.made, self.capacity
            self.made += 1
        if left := room - length:
            self.bins[left].append(k)
            self.free |= 1 << left
            self.open += 1
        return k, self.capacity - room

    def _take(self, room: int) -> int:
        held = self.bins[room]
        k = held.pop()
        self.open -= 1
        if not held:
            self.free &= ~(1 << room)
        return k


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def lots(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows in lots of `most` (the last may have fewer), each longest first and else in the order they come."""
    held, n = [], 0
    for f in frames:
        while len(f):
            held.append(f.iloc[: most - n])
            n, f = n + len(held[-1]), f.iloc[most - n :]
            if n == most:
                yield pd.concat(held).sort_values("length", ascending=False, kind="stable")
                held, n = [], 0
    if held:
        yield pd.concat(held).sort_values("length", ascending=False, kind="stable")


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null text counts as empty; an empty text is one piece that holds the end id alone. Rows with a null or
    repeated id are packed like any other, each with pieces of its own. Ties in length go by hash, id, piece.
    Other columns of df are not read, whatever their names; an empty table gives an empty result.
    """
    id_type = dict(df.dtypes)[id_col]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for f in frames:
            for lo in range(0, len(f), 256):
                out = []
                for doc, text in zip(f["id"][lo : lo + 256], f["text"][lo : lo + 256], strict=True):
                    ids = np.append(enc.encode(text), np.uint32(END_ID)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        out.append((doc, k, start, length, zlib.crc32(own.tobytes()), *([own.astype("i8").tolist()] if with_ids else [])))
                made = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                made["id"] = made["id"].astype(f["id"].dtype if f["id"].notna().all() else "object")
                yield made

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for f in lots(frames, max(1, open_bins // (32 if with_ids else 2))):  # ids are held for a lot
            placed = [fit.place(n) for n in f["length"].tolist()]
            f["sequence_id"] = np.array([base + k for k, _ in placed], dtype="i8")
            f["offset"] = np.array([o for _, o in placed], dtype="i8")
            yield f

    shape = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    by = F.xxhash64("id", "piece", "start", "length", "ids_crc32")
    return (
        df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInPandas(pieces, shape)
        .repartition(by)  # null ids must not meet in one task
        .sortWithinPartitions(by, "id", "piece", "ids_crc32")
        .mapInPandas(packed, f"{shape}, sequence_id long, offset long")
        .withColumnRenamed("id", id_col)
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens (see pack for odd rows)."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
