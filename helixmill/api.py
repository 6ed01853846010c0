"""Objects for single sequences and lists, without a Spark session: the same kernels as the DataFrame operators."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from .functions.codec import LONGEST_K
from .kernels import check_k, codes, encode, kmers, text_of, window_starts
from .operators import cgr, minimisers, oligo
from .operators.kmers import header, position_codes


class OligoComputer:
    """Composition vectors of k-mers of ``ksize`` bases."""

    def __init__(self, ksize: int):
        check_k(ksize, "ksize")
        self.ksize = ksize

    def vectorise_one(self, seq: str, norm: bool = True, mins: bool = True) -> list[float]:
        """Vector of a sequence; canonical k-mers with ``mins``, else all forward ones, whose normalised sum is 0.5."""
        return self.vectorise_batch([seq], norm, mins)[0]

    def vectorise_batch(self, seqs: list[str], norm: bool = True, mins: bool = True) -> list[list[float]]:
        return oligo.vectors(pa.array(seqs, pa.string()), self.ksize, norm, mins, 1 if mins else 2).tolist()

    def get_header(self, mins: bool = True) -> list[str]:
        return header(self.ksize, mins)


class CgrComputer:
    """Chaos-game walks in a square of side ``vecsize``."""

    def __init__(self, vecsize: float = 1):
        self.vecsize = float(vecsize)

    def vectorise_one(self, seq: str) -> list[tuple[float, float]]:
        return self.vectorise_batch([seq])[0]

    def vectorise_batch(self, seqs: list[str]) -> list[list[tuple[float, float]]]:
        for seq in seqs:
            if seq.translate(cgr.BASES):
                raise ValueError("bad base in a sequence")
        code, bounds = codes(pa.array(seqs, pa.string()))
        x, y = cgr.walks(code, bounds, self.vecsize)
        points = list(zip(x.tolist(), y.tolist(), strict=True))
        return [points[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class KmerGenerator:
    """Iterator over (forward, reverse complement) codes of the k-mers of a sequence."""

    def __init__(self, seq: str, ksize: int):
        check_k(ksize, "ksize")
        self.ksize = ksize
        _, forward, reverse = kmers(*codes(pa.array([seq], pa.string())), ksize)
        self._pairs = iter(zip(forward.tolist(), reverse.tolist(), strict=True))

    def __iter__(self) -> KmerGenerator:
        return self

    def __next__(self) -> tuple[int, int]:
        return next(self._pairs)

    def kmer_pos_maps(self) -> tuple[list[int], dict[int, int], int]:
        """(position of each forward code, or 0 for one that isn't canonical; code of each position; number of positions)."""
        chosen = position_codes(self.ksize)
        place = np.zeros(4**self.ksize, np.int64)
        place[chosen] = np.arange(len(chosen))
        return place.tolist(), dict(enumerate(chosen.tolist())), len(chosen)

    def to_acgt(self, code: int) -> str:
        return to_acgt(code, self.ksize)


class MinimiserGenerator:
    """Iterator over (minimiser code, start, end) of the spans of a sequence, as the older implementation has them."""

    def __init__(self, seq: str, wsize: int, msize: int):
        self.msize = msize
        s = minimisers.spans(pa.array([seq], pa.string()), wsize, msize, compat=True)
        self._spans = iter(zip(s.value.tolist(), s.start.tolist(), s.end.tolist(), strict=True))

    def __iter__(self) -> MinimiserGenerator:
        return self

    def __next__(self) -> tuple[int, int, int]:
        return next(self._spans)

    def to_acgt(self, code: int) -> str:
        return to_acgt(code, self.msize)


class KmerMinimiserGenerator:
    """Iterator over (minimiser code, start, end, canonical w-mers): the k-mers of a span, one that brings a new minimiser under the old."""

    def __init__(self, seq: str, wsize: int, msize: int):
        check_k(wsize, "wsize")
        code, bounds = codes(pa.array([seq], pa.string()))
        at, value = minimisers.window_minima(code, bounds, wsize, msize)
        starts = window_starts(code, bounds, wsize)
        forward, reverse = encode(code, wsize) if len(starts) else (np.zeros(0, np.int64),) * 2
        words = np.minimum(forward, reverse)[starts].tolist() if len(starts) else []
        rows: list[tuple[int, int, int, list[int]]] = []
        for i, (place, best) in enumerate(zip(at.tolist(), value.tolist(), strict=True)):
            direct = i > 0 and at[i - 1] == place - 1
            if direct:
                rows[-1][3].append(words[i])
            if direct and rows[-1][0] == best:
                rows[-1] = (*rows[-1][:2], place + wsize, rows[-1][3])
            else:
                rows.append((best, place, place + wsize, [] if direct else [words[i]]))
        self._rows = iter(rows)

    def __iter__(self) -> KmerMinimiserGenerator:
        return self

    def __next__(self) -> tuple[int, int, int, list[int]]:
        return next(self._rows)


def to_acgt(code: int, ksize: int) -> str:
    """Text of a k-mer's code."""
    check_k(ksize, "ksize")
    return text_of(np.array([code], np.int64), ksize)[0].as_py()


def to_numeric(kmer: str) -> tuple[int, int]:
    """Codes of a k-mer and of its reverse complement."""
    if not 1 <= len(kmer) <= LONGEST_K:
        raise ValueError(f"a k-mer has 1 to {LONGEST_K} bases")
    at, forward, reverse = kmers(*codes(pa.array([kmer], pa.string())), len(kmer))
    if not len(at):
        raise ValueError("not a base")
    return int(forward[0]), int(reverse[0])


#: The two codec functions under the name by which they are commonly imported.
utils = SimpleNamespace(to_acgt=to_acgt, to_numeric=to_numeric)
