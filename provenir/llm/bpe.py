"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces of a text (matches of the vocabulary's pattern) are encoded one by one. A piece is a linked list of byte
positions; each pair of neighbours whose bytes form a token lies in the bucket of that token's rank. Three levels of
64-bit words say which buckets hold something, so finding the least rank takes three find-first-set steps however long
the piece is, and each merge pushes at most two new entries: n log n for a piece of n bytes, where scanning all pairs
for each merge takes n squared. An entry whose pair has changed since is stale and is skipped when it comes up.

Defined results: a null text encodes as the empty one; an empty text has no ids; special tokens are ordinary text. Ids
are kept as a binary of little-endian unsigned 32-bit integers, which is what training reads; unpack() gives an array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Pieces that a generation of a Python worker's cache holds, and the longest that is kept; others are encoded anew.
CACHED_PIECES, CACHED_CHARS = 250_000, 48


class Encoder:
    """Encodes pieces by ranks; the queue's words and buckets are kept from piece to piece, empty between them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        n = max(ranks.values()) + 1
        self.ranks, self.pattern, self.find, self.cache = ranks, pattern, regex.compile(pattern).findall, _Cache(self)
        #: Bit r of low says that bucket r holds something, a bit of mid that a word of low is not 0.
        self.low, self.mid = [0] * ((n >> 6) + 1), [0] * ((n >> 12) + 1)
        self.buckets: dict[int, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        low, mid, buckets, top, n = self.low, self.mid, self.buckets, 0, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * (n + 1)  # the rank of the pair that begins here, -1 if it is no token
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap
                else:
                    buckets[r] = [i]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
        while top:
            # The least rank that has a bucket: first set bit of three words.
            a = (top & -top).bit_length() - 1
            m = mid[a]
            b = (a << 6) + (m & -m).bit_length() - 1
            x = low[b]
            rank = (b << 6) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[b] = x = x & (x - 1)
                if not x:
                    mid[a] = m = m & (m - 1)
                    if not m:
                        top &= top - 1
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
            for p in (i, before[i]):
                if p < 0:
                    continue
                q = after[p]
                r = rank_of(piece[p : after[q]]) if q < n else None
                if r is None:
                    pair[p] = -1
                    continue
                pair[p] = r
                if r in buckets:
                    heappush(buckets[r], p)
                else:
                    buckets[r] = [p]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            end = after[i]
            out.append(ranks[piece[i:end]])
            i = end
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text or "")))


class _Cache(dict):
    """Packed ids by piece, in two generations: when the young one is full it becomes the old one, from which what is used
    again is taken over. Frequent pieces so outlive the many that come once."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.encoder.piece(piece.encode())
            ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_kept: list[Encoder] = []


def kept_encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """An encoder that a Python worker keeps from task to task, and with it what it remembers."""
    if not _kept or _kept[0].ranks is not ranks or _kept[0].pattern != pattern:
        _kept[:] = [Encoder(ranks, pattern)]
    return _kept[0]


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class ByteBpe:
    """Encode and decode columns with a vocabulary file; its tokens (a fixed number, a few MB) go to all executors."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.shared, self.pattern = spark.sparkContext.broadcast(load_ranks(path)), pattern

    def encode(self, text: Column) -> Column:
        shared, pattern = self.shared, self.pattern

        @F.arrow_udf("binary")
        def bpe_encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = kept_encoder(shared.value, pattern)
            for batch in texts:
                yield pa.array([encoder.encode(x.as_py()) for x in batch], pa.binary())

        return bpe_encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of packed ids; null: null."""
        shared = self.shared

        @F.arrow_udf("binary")
        def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            token = {v: k for k, v in shared.value.items()}.__getitem__
            for batch in batches:
                yield pa.array([None if (x := y.as_py()) is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for y in batch], pa.binary())

        return bpe_decode(ids)


def n_tokens(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")


def unpack(ids: Column) -> Column:
    """Packed ids as array<long>."""

    @F.arrow_udf("array<bigint>")
    def bpe_unpack(batch: pa.Array) -> pa.Array:
        return pa.array([None if (x := y.as_py()) is None else np.frombuffer(x, "<u4").astype(np.int64) for y in batch], pa.list_(pa.int64()))

    return bpe_unpack(ids)
