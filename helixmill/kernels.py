"""Numpy kernels over batches of sequences: k-mer windows, sliding minima, chaos-game points.

All take an Arrow string array and work on its characters in one row of codes; offsets count characters. Codes follow the
public 2-bit convention: A 0, C 1, G 2, T or U 3, in either case; any other character is ambiguous. The raw code points
0 to 3 stand for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AMBIGUOUS = 4
#: Characters in a block; longer sequences are scanned in overlapping stretches of this length.
BLOCK = 1 << 20
LONGEST_K = 31

CODES = np.full(256, AMBIGUOUS, np.uint8)
for _code, _letters in enumerate(("Aa\x00", "Cc\x01", "Gg\x02", "TtUu\x03")):
    CODES[[ord(c) for c in _letters]] = _code


def check_k(k: int, name: str = "k") -> None:
    if not 1 <= k <= LONGEST_K:
        raise ValueError(f"{name} must be from 1 to {LONGEST_K}")


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all characters of the texts in a row, and the n + 1 bounds of the texts. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    bounds = np.zeros(n + 1, np.int64)
    if not n:
        return np.zeros(0, np.uint8), bounds
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not (data & 0x80).any():
        bounds[:] = offsets - offsets[0]
        return CODES[data], bounds
    head = (data & 0xC0) != 0x80  # one code for each character, wherever it has several bytes
    place = np.concatenate(([0], np.cumsum(head)))
    bounds[:] = place[offsets - offsets[0]]
    return CODES[data[head]], bounds


def stretches(texts: pa.Array, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes in blocks of about ``BLOCK`` characters: (codes, bounds, rows, where each part starts in its text, lengths).

    A text that is longer than a block comes in parts that overlap by ``reach`` - 1 characters, so that every window of
    ``reach`` characters lies in exactly one of them. ``lengths`` are the lengths of the whole texts.
    """
    flat, bounds = codes(texts)
    sizes = np.diff(bounds)
    n, row = len(sizes), 0
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + BLOCK, "right")) - 1
        stop = min(max(stop, row + 1), n)
        if stop == row + 1 and sizes[row] > BLOCK + reach:
            for begin in range(0, int(sizes[row]) - reach + 1, BLOCK):
                part = flat[bounds[row] + begin : min(bounds[row] + begin + BLOCK + reach - 1, bounds[row + 1])]
                yield part, np.array([0, len(part)]), np.array([row]), np.array([begin]), sizes[row : row + 1]
        else:
            part = flat[bounds[row] : bounds[stop]]
            rows = np.arange(row, stop)
            yield part, bounds[row : stop + 1] - bounds[row], rows, np.zeros(stop - row, np.int64), sizes[row:stop]
        row = stop


def window_starts(code: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Places where a window of k unambiguous characters begins that stays within its text."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    bad = np.concatenate(([0], np.cumsum(code == AMBIGUOUS, dtype=np.int32)))
    ok &= bad[k:] == bad[:-k]
    inner = bounds[1:-1]
    if len(inner) and k > 1:  # windows over a text's end
        over = np.zeros(len(code) + 1, np.int32)
        np.add.at(over, np.maximum(inner - k + 1, 0), 1)
        np.add.at(over, inner, -1)
        ok &= np.cumsum(over[:-1])[:n] == 0
    return np.flatnonzero(ok)


def encode(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every k-window read forward and as its reverse complement, by doubling; ambiguous windows hold rubbish."""
    kind = np.int64 if k > 15 else np.int32
    one = (code & 3).astype(kind)
    doubled = {1: (one, 3 - one)}
    width = 1
    while width * 2 <= k:
        doubled[width * 2] = _glue(doubled[width], width, doubled[width], width)
        width *= 2
    forward, done = doubled[width], width
    while done < k:
        part = max(w for w in doubled if w <= k - done)
        forward, done = _glue(forward, done, doubled[part], part), done + part
    return forward


def _glue(a: tuple[np.ndarray, np.ndarray], m: int, b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(0, min(len(a[0]), len(b[0]) - m))
    return (a[0][:size] << 2 * n) | b[0][m : m + size], (b[1][m : m + size] << 2 * m) | a[1][:size]


def kmers(code: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid windows of a block: (places, forward codes, reverse-complement codes)."""
    at = window_starts(code, bounds, k)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    forward, reverse = encode(code, k)
    return at, forward[at], reverse[at]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each stretch of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[: len(values) - (width - done)], values[width - done :])
    return values


def text_of(code: np.ndarray, k: int) -> pa.Array:
    """ACGT strings of k-mer codes."""
    if not len(code):
        return pa.array([], pa.string())
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.int64)
    letters = np.frombuffer(b"ACGT", np.uint8)[(code.astype(np.int64)[:, None] >> shifts) & 3]
    offsets = pa.py_buffer(np.arange(0, (len(code) + 1) * k, k, dtype=np.int32))
    return pa.StringArray.from_buffers(len(code), offsets, pa.py_buffer(np.ascontiguousarray(letters)))


def canonical_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct canonical k-mers of each text, ascending, in a row; and the n + 1 bounds of the texts."""
    owners, values = [], []
    for code, bounds, row, _, _ in stretches(texts, k):
        at, forward, reverse = kmers(code, bounds, k)
        owner, value, _ = tally(row[np.searchsorted(bounds, at, "right") - 1], np.minimum(forward, reverse).astype(np.int64), k)
        if owners and len(owner) and len(owners[-1]) and owners[-1][-1] == owner[0]:  # parts of one long text
            owner, value, _ = tally(np.concatenate((owners.pop(), owner)), np.concatenate((values.pop(), value)), k)
        owners.append(owner)
        values.append(value)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return np.concatenate(values) if values else owner, np.searchsorted(owner, np.arange(len(texts) + 1))


def tally(owner: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of owner and k-mer in order, and how often each occurs."""
    if not len(owner):
        return owner, value, owner
    if int(owner.max()).bit_length() + 2 * k < 63:  # both fit one word, which sorts much faster
        both, times = np.unique(owner << (2 * k) | value, return_counts=True)
        return both >> (2 * k), both & ((1 << 2 * k) - 1), times
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
    return owner[heads], value[heads], np.diff(np.append(heads, len(owner)))
