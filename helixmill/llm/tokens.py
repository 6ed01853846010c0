"""Encoding of a corpus by a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves every pre-token that is a vocabulary entry as a whole;
any other pre-token is merged by a heap over its linked bytes, once a worker as long as it stays in a cache. Scanning,
hashing, look-up and assembly are numpy passes over whole blocks of text, so Python runs a loop only for new words.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .spans import SpanCache, blocks, fingerprints, mix, pretoken_starts

#: Folder of the public tokenizers' files; the environment variable overrides it.
TOKENIZERS = os.environ.get("HELIXMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Ids that a worker keeps for merged words before it starts over.
CACHE_IDS = 4_000_000


def vocabulary_path(name: str = BYTE_BPE_50K, folder: str | None = None) -> str:
    return str(Path(folder or TOKENIZERS, name))


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: one entry in each line, base64 of its bytes and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Minimal perfect hash of 64-bit fingerprints: n keys in n slots, by hash and displace.

    Keys fall into buckets of about four; largest first, each bucket gets the first displacement that sends all its
    keys to free slots. A look-up reads a displacement and a slot, and compares the whole fingerprint kept there.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.size = n = len(keys)
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.keys = np.zeros(n, np.uint64)
        self.values = np.zeros(n, np.int32)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        tries = np.arange(512, dtype=np.uint64)[:, None]
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            at = order[bounds[b] : bounds[b + 1]]
            if not len(at):
                break
            first = 0
            while True:
                slots = self._slot(keys[at][None, :], tries + np.uint64(first))
                ok = ~taken[slots].any(1)
                if len(at) > 1:
                    ranked = np.sort(slots, 1)
                    ok &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if ok.any():
                    break
                first += len(tries)
            pick = int(np.argmax(ok))
            self.shift[b] = first + pick
            taken[slots[pick]] = True
            self.keys[slots[pick]], self.values[slots[pick]] = keys[at], values[at]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        low = mix(keys + shift * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return ((low * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 for a key that isn't in the table."""
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        slots = self._slot(keys, self.shift[self._bucket(keys)])
        return np.where(self.keys[slots] == keys, self.values[slots], -1)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding of one pre-token: bytes in a doubly linked list, the best-ranked neighbours in a heap.

    Equal ranks merge from the left. Entries of the heap whose neighbours have changed since are skipped.
    """
    n = len(word)
    if n == 1:
        return [ranks[word]]
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        if end[left] < 0 or (right := after[left]) >= n or end[right] != stop:
            continue
        end[left], end[right] = stop, -1
        after[left] = follow = after[right]
        if follow < n:
            before[follow] = left
            if (r := ranks.get(word[left : end[follow]])) is not None:
                heapq.heappush(heap, (r, left, end[follow]))
        if (prior := before[left]) >= 0 and (r := ranks.get(word[prior:stop])) is not None:
            heapq.heappush(heap, (r, prior, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes Arrow string arrays; lives in a worker and is built there once from the rank file's entries."""

    def __init__(self, ranks: dict[bytes, int], cache_bits: int = 18):
        self.ranks = ranks
        entries = []
        for word, i in ranks.items():
            try:
                text = word.decode("utf-8")
            except UnicodeDecodeError:  # part of a character: never a pre-token of its own
                continue
            entries.append((text, i))
        cp = np.frombuffer("".join(t for t, _ in entries).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t, _ in entries])
        starts = np.concatenate(([0], ends[:-1]))
        prints = fingerprints(cp, starts, ends)
        ids = np.array([i for _, i in entries], np.int32)
        if len(np.unique(prints)) < len(prints):
            raise ValueError("two vocabulary entries have one fingerprint")
        self.whole = PerfectHash(prints, ids)
        self.base = max(ranks.values()) + 1
        self.cache_bits = cache_bits
        self._reset()

    def _reset(self) -> None:
        self.cache = SpanCache(self.cache_bits)
        self.flat = np.concatenate((np.arange(self.base, dtype=np.int32), np.zeros(1 << 16, np.int32)))
        self.used = self.base
        self.offset = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.words = 0

    def _add(self, ids: list[int]) -> int:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.int32)))
        if self.words == len(self.offset):
            self.offset = np.concatenate((self.offset, np.zeros(self.words, np.int64)))
            self.length = np.concatenate((self.length, np.zeros(self.words, np.int64)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[self.words], self.length[self.words] = self.used, len(ids)
        self.used += len(ids)
        self.words += 1
        return self.words - 1

    def _spans(self, cp: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pre-tokens, and where in ``flat`` the ids of each begin and how many they are."""
        if self.used > self.base + CACHE_IDS:
            self._reset()
        starts = pretoken_starts(cp, docs)
        ends = np.append(starts[1:], len(cp)).astype(np.int64)
        prints = fingerprints(cp, starts, ends)
        at = self.whole.get(prints).astype(np.int64)
        size = np.ones(len(at), np.int64)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            rare = prints[missed]
            word = self.cache.get(rare)
            new = np.flatnonzero(word < 0)
            if len(new):
                kinds, first, back = np.unique(rare[new], return_index=True, return_inverse=True)
                numbers = np.empty(len(kinds), np.int64)
                for k, j in enumerate(missed[new[first]].tolist()):
                    text = cp[starts[j] : ends[j]].tobytes().decode("utf-32-le", "surrogatepass")
                    numbers[k] = self._add(merge_bytes(text.encode("utf-8", "surrogatepass"), self.ranks))
                self.cache.put(kinds, numbers)
                word[new] = numbers[back]
            at[missed], size[missed] = self.offset[word], self.length[word]
        return starts, at, size

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of each text; null and empty texts have the empty list."""
        counts = np.zeros(len(texts), np.int64)
        parts = []
        for cp, docs, rows in blocks(texts):
            starts, at, size = self._spans(cp, docs)
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            parts.append(self.flat[np.repeat(at - (ends - size), size) + np.arange(total)])
            np.add.at(counts, rows, _per_text(starts, size, docs))
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(counts, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        counts = np.zeros(len(texts), np.int64)
        for cp, docs, rows in blocks(texts):
            starts, _, size = self._spans(cp, docs)
            np.add.at(counts, rows, _per_text(starts, size, docs))
        return counts


def _per_text(starts: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(size)))
    bounds = np.append(np.searchsorted(starts, docs), len(starts))
    return sums[bounds[1:]] - sums[bounds[:-1]]


@lru_cache(maxsize=2)
def _encoder(packed: bytes) -> Encoder:
    return Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.splitlines() if x.strip())})


class _Shipped:
    """The rank file (under 1 MB, a size fixed by the vocabulary) as a broadcast value."""

    def __init__(self, df: DataFrame, path: str):
        self.value = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def encoder(self) -> Encoder:
        return _encoder(self.value.value)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Columns ``key`` and ``out``: the token ids of every text, one row for each input row.

    Strings that look like special tokens are ordinary text. Null and empty texts have an empty list, blank text is
    encoded like any other, repeated rows come out as often as they came in, an empty table gives an empty table. Other
    columns are left aside, so a column of the input that is called ``out`` does no harm. One pass over the scan, without
    a shuffle (a small table in few files is dealt out to all cores first), and only the two columns are read.
    """
    shipped = _Shipped(df, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shipped.encoder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(batch.column(1))], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key), F.col(text).cast("string").alias("_text")))
    return rows.mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``out``: how many tokens each text has (0 for null and empty texts)."""
    shipped = _Shipped(df, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shipped.encoder()
        for batch in batches:
            counts = pa.array(encoder.count(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, out])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    rows = spread(df.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("_text")))
    return rows.mapInArrow(run, f"{kinds}, `{out}` bigint")
