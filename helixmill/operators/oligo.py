"""Composition vectors: how often each k-mer occurs in a sequence, dense, in order of the k-mers' codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import kmers, stretches
from .kmers import header, kind_of, position_codes, scan

#: Cells of a vector matrix in the making.
CELLS = 1 << 22


def composition(texts: pa.Array, k: int, canonical_only: bool = True) -> np.ndarray:
    """Counts of each text: texts x positions."""
    codes = position_codes(k, canonical_only)
    place = np.full(4**k, -1, np.int64)
    place[codes] = np.arange(len(codes))
    counts = np.zeros((len(texts), len(codes)))
    for code, bounds, rows, _, _ in stretches(texts, k):
        at, forward, reverse = kmers(code, bounds, k)
        if len(at):
            owner = np.searchsorted(bounds, at, "right") - 1
            cell = owner * len(codes) + place[np.minimum(forward, reverse) if canonical_only else forward]
            counts[rows] += np.bincount(cell, minlength=len(rows) * len(codes)).reshape(len(rows), -1)
    return counts


def vectors(texts: pa.Array, k: int, norm: bool, canonical_only: bool, denominator: int) -> np.ndarray:
    counts = composition(texts, k, canonical_only)
    return counts / np.maximum(1, denominator * counts.sum(1, keepdims=True)) if norm else counts


def oligo_vectors(df: DataFrame, k: int = 3, norm: bool = True, canonical_only: bool = True, denominator: int = 1, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, kvec: one row for each input row; all zero where there is no k-mer.

    With ``norm`` the vector is divided by its sum, or by ``denominator`` times its sum: 2 gives the halved forward
    vectors of the older object interface.
    """
    width = len(position_codes(k, canonical_only))
    step = max(1, CELLS // width)

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), step):
            part = vectors(texts.slice(a, step), k, norm, canonical_only, denominator)
            offsets = pa.array(np.arange(0, part.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys.slice(a, step), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=[key, "kvec"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, kvec array<double>")


def long_form(vectors: DataFrame, k: int, canonical_only: bool = True, key: str = "n", column: str = "kvec") -> DataFrame:
    """Columns ``key``, pos, kmer, value of composition vectors. The names are a literal of 4^k at most."""
    names = F.array(*[F.lit(x) for x in header(k, canonical_only)])
    return vectors.select(F.col(key), F.posexplode(column).alias("pos", "value"), names.alias("_names")).select(key, "pos", F.col("_names")[F.col("pos")].alias("kmer"), "value")
