"""Vectorised text scanning: code points, character classes, pre-token spans and span fingerprints in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER, HAN = 0, 1, 2, 3, 4

#: Code points of the White_Space property (fixed values of the Unicode standard).
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

#: Text is scanned in blocks of about so many bytes, so that the arrays stay in the CPU's caches.
BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = 1 << 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: white space, letter (L*), number (N*) or anything else."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(maxsize=1)
def word_classes() -> np.ndarray:
    """As ``classes``, with Han ideographs apart: they are written without spaces, so each stands alone."""
    table = classes().copy()
    for first, last in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
        part = table[first : last + 1]
        part[part == LETTER] = HAN
    return table


@lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """Lower-case form of every code point that has one of a single code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in np.flatnonzero(classes() == LETTER):
        low = chr(cp).lower()
        if len(low) == 1:
            table[cp] = ord(low)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _char_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the fingerprint's base and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, _WORD))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def fingerprints(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of spans, from one prefix sum over all code points.

    Each code point counts with its own random word times a power of the base, so a fingerprint depends on what stands
    in the span and not on where the span is. The chance that two different spans agree is about 2**-60 a pair.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.to(len(cp))
    sums = np.empty(len(cp) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_char_codes()[cp] * up[: len(cp)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def pretoken_starts(cp: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the public byte-level pattern (``public_tokenizers.PATTERN``).

    cp: code points of several texts in a row; docs: where each text starts, ascending. Runs of one class decide: a
    single blank before a run of letters, numbers or other signs belongs to that run; white space before it keeps its
    last character apart; at the end of a text it stays whole. An apostrophe that begins a pre-token takes one of the
    English contraction endings with it.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[docs] = True
    first = fresh[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(first)
    ends = np.append(runs[1:], n)
    space = kind[runs] == SPACE
    goes_on = np.append(~fresh[runs[1:]], False)  # the next run is in the same text
    attached = np.zeros(len(runs), bool)
    attached[1:] = space[:-1] & goes_on[:-1] & (cp[ends[:-1] - 1] == 0x20)
    mark = np.zeros(n + 1, bool)
    mark[runs[~attached]] = True
    mark[ends[space & goes_on] - 1] = True
    quote = np.flatnonzero((cp[runs] == 0x27) & (ends - runs == 1) & goes_on & ~attached)
    if len(quote):
        at = runs[quote]
        letters = ends[np.minimum(quote + 1, len(runs) - 1)] - at - 1
        after = cp[at + 1]
        then = cp[np.minimum(at + 2, n - 1)]
        two = (letters >= 2) & (((after == ord("r")) | (after == ord("v"))) & (then == ord("e")) | (after == ord("l")) & (then == ord("l")))
        one = np.isin(after, [ord(c) for c in "stmd"])
        hit = one | two
        mark[at[hit] + 1] = False
        mark[at[hit] + np.where(one, 2, 3)[hit]] = True
    return np.flatnonzero(mark[:n])


_CUT = re.compile(r"(?<=\S)\s")


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of an Arrow string array in blocks: (code points, starts of the texts, their row numbers).

    Null counts as empty. A text far above the block size is cut where white space begins, which no pre-token spans;
    its parts come one after another under the same row number. Damaged UTF-8 reads as U+FFFD.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) is False and pa.types.is_string(texts.type) is False:
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), n)
        raw = bytes(data[offsets[row] : offsets[stop]])
        if stop == row + 1 and len(raw) > 4 * BLOCK_BYTES:
            text = raw.decode("utf-8", "replace")
            begin = 0
            while begin < len(text):
                cut = _CUT.search(text, begin + BLOCK_BYTES) if begin + BLOCK_BYTES < len(text) else None
                end = cut.start() if cut else len(text)
                yield _points(text[begin:end]), np.zeros(1, np.int64), np.array([row])
                begin = end
        else:
            try:
                text = raw.decode("utf-8")
                sizes = pc.utf8_length(texts.slice(row, stop - row)).to_numpy(zero_copy_only=False)
            except UnicodeDecodeError:
                parts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[row:stop], offsets[row + 1 : stop + 1], strict=True)]
                text, sizes = "".join(parts), np.array([len(p) for p in parts])
            begins = np.zeros(stop - row, np.int64)
            np.cumsum(sizes[:-1], out=begins[1:])
            yield _points(text), begins, np.arange(row, stop)
        row = stop


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class SpanCache:
    """Direct-mapped table from fingerprint to a number; a newcomer takes the slot of what was there."""

    def __init__(self, bits: int = 18):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)

    def get(self, prints: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        slots = (prints & self.mask).astype(np.int64)
        return np.where(self.keys[slots] == prints, self.values[slots], -1)

    def put(self, prints: np.ndarray, values: np.ndarray) -> None:
        slots = (prints & self.mask).astype(np.int64)
        _, last = np.unique(slots[::-1], return_index=True)
        last = len(slots) - 1 - last
        self.keys[slots[last]] = prints[last]
        self.values[slots[last]] = values[last]
