"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that has a merge rank is filed in the bucket of its rank; a
bitmap of two levels (words of 1024 ranks) tells which buckets hold positions, and find-first-set on it gives the lowest rank. A bucket
gives its leftmost position first. Entries whose pair has changed since are skipped when they come up. So a pre-token
of n bytes costs about n log n however long it is, where rescanning the pairs costs n squared.

White-space-separated pieces repeat, so their ids are kept in two generations of up to KEPT pieces a worker (twice as
many pre-tokens); results don't depend on it. A text is split at single spaces where that gives the same pre-tokens as the pattern on
the whole text, which holds unless the text starts or ends with white space or has two such characters in a row.

Nulls: a null text is the empty one and has no ids. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import Generations, no_collection

KEPT, LONG = 350_000, 1 << 20
BIT = [1 << k for k in range(1024)]


class Encoder:
    """Ranks of a vocabulary and the pattern that splits texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.words = [0] * ((max(ranks.values()) >> 10) + 1)
        self.pieces = regex.compile(pattern)
        self.odd = regex.compile(r"\A\s|\s\s|\s\Z")
        self.table = {r: b for b, r in ranks.items()}
        self.spaced, self.tokens = Generations(KEPT, self.spaced_ids), Generations(2 * KEPT, self.packed)

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. buckets: positions by merge rank, each a heap; words and top: a bitmap of the buckets that
        hold any and a bitmap of the words that do. The steps stand in line, as most pre-tokens are a few bytes long."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, get = len(piece), self.ranks.get
        words, buckets, top = self.words, {}, 0  # words are all 0 again at the end
        end = list(range(1, n + 2))  # of the part that starts here; 0: merged into the part before
        before = list(range(-1, n))
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise, so this is a heap
                else:
                    buckets[rank] = [i]
                    w = rank >> 10
                    words[w] |= BIT[rank & 1023]
                    top |= BIT[w]
        while top:
            first = top & -top
            w = first.bit_length() - 1
            word = words[w]
            bit = word & -word
            rank = w << 10 | bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[w] = word ^ bit
                if word == bit:
                    top ^= first
            j = end[i]
            if not j or j >= n:
                continue  # stale
            k = end[j]
            if get(piece[i:k]) != rank:
                continue  # stale
            end[i], end[j] = k, 0
            h = before[i]
            if k < n:
                before[k] = i
                fresh = ((i, get(piece[i : end[k]])), (h, get(piece[h:k]) if h >= 0 else None))
            else:
                fresh = ((h, get(piece[h:k]) if h >= 0 else None),)
            for at, rank in fresh:
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        w = rank >> 10
                        words[w] |= BIT[rank & 1023]
                        top |= BIT[w]
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(self.ranks[piece[i:j]])
            i = j
        return out

    def packed(self, token: str) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        return array("I", self.merge(token.encode())).tobytes()

    def spaced_ids(self, word: str) -> bytes:
        """Ids of a space and a word without white space around it."""
        return b"".join(map(self.tokens.__getitem__, self.pieces.findall(" " + word)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        if not text:
            return b""
        ids = self.tokens.__getitem__
        if self.odd.search(text):
            if len(text) <= LONG:
                return b"".join(map(ids, self.pieces.findall(text)))
            found, parts = self.pieces.finditer(text), []
            while part := b"".join(ids(m[0]) for m in islice(found, 1 << 16)):
                parts.append(part)
            return b"".join(parts)
        words = text.split(" ")
        head = b"".join(map(ids, self.pieces.findall(words[0])))
        return head + b"".join(map(self.spaced.__getitem__, words[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, array("I", ids)))


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder.load(path, pattern)
    return _LOADED[path, pattern]


def over_texts(docs: DataFrame, schema: str, rows: Callable[[list, list[str]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """rows(doc_ids, texts) for every Arrow batch of (doc_id, text)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with no_collection():
                out = list(rows(b.column(0), b.column(1)))
            yield from out

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(scan, schema)


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): whole texts encoded."""

    def rows(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for i, text in zip(ids, texts):
            got = np.frombuffer(own.encode(text.as_py()), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], ids.type), pa.array([got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return over_texts(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", rows)


def decode_table(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary): the bytes that the ids stand for."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            data = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode every text, decode its ids, and digest both, in one scan."""

    def rows(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        own = encoder(path, pattern)
        n, a, b = [], [], []
        for text in texts:
            got = own.encode(text.as_py())
            n.append(len(got) // 4)
            a.append(sha256(got).hexdigest())
            b.append(sha256(own.decode(got)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_texts(docs, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
