"""Problem 8: encoding with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids are kept in a worker, and their greatest length; both bound its memory.
CACHED_WORDS, CACHED_LENGTH = 200_000, 64


class Encoder:
    """Ranks of a vocabulary and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word.

        The symbols are a doubly linked list; a heap holds (rank, left symbol, the lengths it was made
        for). The least rank merges first, at equal rank the leftmost. An entry whose symbols have
        changed since is stale and skipped.
        """
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        symbols: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapify(heap)
        while heap:
            rank, i, length = heappop(heap)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j < 0 or len(left) + len(symbols[j]) != length or ranks.get(left + symbols[j]) != rank:
                continue
            symbols[i] = merged = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks.get(merged + symbols[k])
                if rank is not None:
                    heappush(heap, (rank, i, length + len(symbols[k])))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + merged)
                if rank is not None:
                    heappush(heap, (rank, h, length + len(symbols[h])))
        return [ranks[s] for s in symbols if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; none for a null or an empty text."""
        ids: list[int] = []
        if not text:
            return ids
        known, extend = self.known, ids.extend
        for word in self.split(text):
            found = known.get(word)
            if found is None:
                found = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
                if len(word) <= CACHED_LENGTH:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = found
            extend(found)
        return ids

    def decode(self, ids) -> str:
        """The text of ``ids``: the vocabulary's strings one after another."""
        return b"".join(self.strings[int(i)] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int), one row for each input row, without an exchange.

    Null and empty texts have the empty list. Other columns, whatever their names, are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # texts can be long: small batches out
                part = batch.slice(at, 500)
                lists = [of.encode(t) for t in part.column("_text").to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, "ids"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"])
    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: tuple[str, ...], path: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``; the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for batch in batches:
            counts = pa.array([len(of.encode(t)) for t in batch.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], [*keep, "n_tokens"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long"])
    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)
