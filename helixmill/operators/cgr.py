"""Chaos-game representation of sequences, and of k-mers with their frequencies.

A square of side ``size`` has a corner for each base: A (0, 0), C (0, size), G (size, size), T and U (size, 0). The walk
starts in the middle; each base moves it half the way to its corner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..kernels import AMBIGUOUS, check_k, codes
from .kmers import header, kind_of, position_codes, scan
from .oligo import CELLS, vectors

#: Bases of a lane of a long walk, and bases that a lane runs ahead of its start.
LANE = 8192
AHEAD = 128
#: Bases that are walked at a time; a batch with more comes out in parts.
LETTERS = 1 << 22
#: Letters with a corner (a table for ``str.translate`` that takes them away).
BASES = dict.fromkeys(map(ord, "ACGTUacgtu"))
_X = np.array([0, 0, 1, 1], float)
_Y = np.array([0, 1, 1, 0], float)


def kmer_size(k: int) -> int:
    """Default side of the square for k-mers: k squared."""
    return int((k**4) ** 0.5)


def _walk(corner: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Walks over several stretches of ``corner`` in step; stretch i begins at the value ``first[i]``."""
    out = np.empty(len(corner))
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, state, sizes = starts[order], first[order].copy(), sizes[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, "left"))
        state = state[:live]
        state += corner[at[:live] + step]
        state *= 0.5
        out[at[:live] + step] = state
    return out


def walks(code: np.ndarray, bounds: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every base of clean sequences, bit for bit as a walk from base to base gives them.

    Long sequences run as many lanes at once. A lane starts some bases early in the middle of the square; as each step
    halves what is left of a start, it meets the true walk before its own bases begin. Whether it does is checked, and a
    lane that doesn't is walked again from the true value.
    """
    begins, owners = [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        lanes = np.arange(a, max(b, a + 1), LANE)
        begins.append(lanes)
        owners.append(np.full(len(lanes), i))
    begin, owner = np.concatenate(begins or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    end = np.minimum(begin + LANE, bounds[owner + 1]) if len(owner) else begin
    early = np.maximum(begin - AHEAD, bounds[owner]) if len(owner) else begin
    out = []
    for side in (_X, _Y):
        corner = side[code] * size
        ahead = np.full(len(begin), size / 2)
        inner = np.flatnonzero(early < begin)
        for j in range(AHEAD):
            ahead[inner] = (ahead[inner] + corner[early[inner] + j]) * 0.5
        points = _walk(corner, begin, end, ahead)
        for lane in inner:
            if points[begin[lane] - 1] != ahead[lane]:
                state = points[begin[lane] - 1]
                for j in range(begin[lane], end[lane]):
                    state = (state + corner[j]) * 0.5
                    points[j] = state
        out.append(points)
    return out[0], out[1]


def cgr_paths(df: DataFrame, size: float = 1.0, mode: str = "FAILFAST", key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, path (array of x, y), error: the walk of each sequence, one point for each base.

    A letter other than ACGTU in either case is an error: with ``FAILFAST`` the query fails, with ``PERMISSIVE`` the path
    is null and error names the letter. Null and empty sequences have an empty path.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        code, bounds = codes(texts)
        step = max(1, int(np.searchsorted(bounds, LETTERS, "right")) - 1) if len(code) > LETTERS else max(1, len(keys))
        for a in range(0, len(keys), step):
            yield _paths(keys.slice(a, step), texts.slice(a, step), size, mode, key)

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, path array<struct<x: double, y: double>>, error string")


def _paths(keys: pa.Array, texts: pa.Array, size: float, mode: str, key: str) -> pa.RecordBatch:
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    code, bounds = codes(pa.compute.replace_substring_regex(texts, "[\\x00-\\x03]", "N"))  # no bases here
    bad = np.flatnonzero(code == AMBIGUOUS)
    row, first = np.unique(np.searchsorted(bounds, bad, "right") - 1, return_index=True)
    errors = np.full(len(texts), None, object)
    for i, place in zip(row.tolist(), (bad[first] - bounds[row]).tolist(), strict=True):  # rows with an error only
        errors[i] = f"bad base {texts[i].as_py()[place]!r}"
    if len(row):
        if mode == "FAILFAST":
            raise ValueError(errors[row[0]])
        code, bounds = codes(pa.compute.if_else(pa.array(np.isin(np.arange(len(texts)), row, invert=True)), texts, ""))
    x, y = walks(code, bounds, size)
    failed = np.zeros(len(texts) + 1, bool)
    failed[row] = True
    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(point))
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=failed), points), pa.array(errors, pa.string())], names=[key, "path", "error"])


def kmer_points(k: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """End point of the walk over each canonical k-mer, in order of the k-mers' codes."""
    check_k(k)
    letters = position_codes(k)[:, None] >> np.arange(2 * (k - 1), -1, -2) & 3
    x = y = np.full(len(letters), size / 2)
    for i in range(k):
        x, y = (x + _X[letters[:, i]] * size) * 0.5, (y + _Y[letters[:, i]] * size) * 0.5
    return x, y


def kmer_cgr(df: DataFrame, k: int, size: float | None = None, norm: bool = True, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, points (array of x, y, freq): the point of each canonical k-mer with its frequency in the sequence.

    Ambiguous letters are skipped. The points are the same for all rows and are computed once a worker.
    """
    side = float(kmer_size(k) if size is None else size)
    width = len(position_codes(k))
    step = max(1, CELLS // width)
    kind = [("x", pa.float64()), ("y", pa.float64()), ("freq", pa.float64())]

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        x, y = kmer_points(k, side)
        for a in range(0, len(keys), step):
            part = vectors(texts.slice(a, step), k, norm, True, 1)
            points = pa.StructArray.from_arrays([pa.array(np.tile(x, len(part))), pa.array(np.tile(y, len(part))), pa.array(part.ravel())], fields=[pa.field(*f) for f in kind])
            offsets = pa.array(np.arange(0, part.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys.slice(a, step), pa.ListArray.from_arrays(offsets, points)], names=[key, "points"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, points array<struct<x: double, y: double, freq: double>>")


def kmer_point_table(spark: SparkSession, k: int, size: float | None = None) -> DataFrame:
    """Columns pos, kmer, x, y of all canonical k-mers."""
    x, y = kmer_points(k, float(kmer_size(k) if size is None else size))
    return spark.createDataFrame([(i, name, float(a), float(b)) for i, (name, a, b) in enumerate(zip(header(k), x, y, strict=True))], "pos int, kmer string, x double, y double")


def cgr_path_sql(seq, size: float = 1.0):
    """Column with the walk of a short sequence by built-in expressions alone; its cost grows with the square of the length."""
    start = F.array(F.struct(F.lit(size / 2).alias("x"), F.lit(size / 2).alias("y")))
    last = lambda path: F.element_at(path, -1)

    def step(path, base):
        x, y = codec.corner(base, "x", size), codec.corner(base, "y", size)
        return F.concat(path, F.array(F.struct(((last(path)["x"] + x) / 2).alias("x"), ((last(path)["y"] + y) / 2).alias("y"))))

    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda path: F.slice(path, F.lit(2), F.size(path) - 1))
