"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of bytes. Every adjacent pair that is a token waits in the bucket of its merge
rank, a heap of list positions. Which buckets hold anything is kept in two levels of bits: one integer whose bits
are words, and per word 256 bits that are ranks; two find-first-set operations give the lowest rank, so picking
the next merge costs the same however long the pre-token is. Entries whose pair has changed since are skipped
when they come up.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import mapped, table

CACHE = 400_000
_loaded: dict = {}


class Codec(dict):
    """Encodes and decodes by a rank file; as a dict it keeps the ids of the pre-tokens met last."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(tok): int(r) for tok, r in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for tok, r in self.ranks.items():
            self.tokens[r] = tok
        self.split = regex.compile(pattern).findall
        # the queue, empty between pre-tokens
        self.buckets: list[list[int]] = [[] for _ in self.tokens]
        self.words = [0] * (len(self.tokens) // 256 + 1)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode())
        if len(piece) <= 64:  # a long one is not likely to come again
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> tuple[int, ...]:
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return (whole,)
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        buckets, words, top = self.buckets, self.words, 0
        for i, r in enumerate(pair):
            if r is not None:
                buckets[r].append(i)
                words[r >> 8] |= 1 << (r & 255)
                top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            r = w << 8 | (bits & -bits).bit_length() - 1
            held = buckets[r]
            i = heappop(held)
            if not held:
                words[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = None
            if k < n:
                before[k] = i
                pair[i] = q = rank_of(piece[i : after[k]])
                if q is not None:
                    heappush(buckets[q], i)
                    words[q >> 8] |= 1 << (q & 255)
                    top |= 1 << (q >> 8)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = q = rank_of(piece[h:k])
                if q is not None:
                    heappush(buckets[q], h)
                    words[q >> 8] |= 1 << (q & 255)
                    top |= 1 << (q >> 8)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str | None = None) -> Codec:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """The carried columns (all by default) and ids, array<int>. Null texts count as empty and have no ids.

    Rows are encoded one by one and whole, so nulls and repeats elsewhere don't matter, and an empty table gives an
    empty result. Carried columns may have any names; one named ids gives way to the result.
    """
    return mapped(df, carry or df.columns, text_col, "ids array<int>", lambda texts: [[codec(path, pattern).encode(t or "") for t in texts]])


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The carried columns and decoded, binary: the bytes that the ids stand for (null ids: none).

    Odd rows as in bpe_encode; a column named decoded gives way to the result.
    """
    return mapped(df, carry or df.columns, ids_col, "decoded binary", lambda rows: [[codec(path).decode(ids or ()) for ids in rows]])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to (see bpe_encode for odd rows)."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def both(texts: list) -> list[list]:
        c = codec(path)
        ids = [c.encode(t or "") for t in texts]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [[len(x) for x in ids], [sha(np.array(x, "<u4").tobytes()) for x in ids], [sha(c.decode(x)) for x in ids]]

    return mapped(table(spark, sf_dir, "documents"), ["doc_id"], "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", both)
