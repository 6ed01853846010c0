"""Numeric vectors out of Arrow lists, and classes of equal vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``width`` finite numbers, not all zero, and their matrix. Null or other rows are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lists = lists.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == width)
    if not len(fit):
        return fit, np.zeros((0, width))
    values = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), width)
    ok = np.isfinite(values).all(1) & (values != 0).any(1)
    return fit[ok], values[ok]


def stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Matrix of a list column whose lists are of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(values: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def rows_of(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(values).ravel()))


def packed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, which Spark moves as they are instead of number by number."""
    n = len(values)
    size = values.shape[1] * values.itemsize
    offsets = pa.py_buffer(np.arange(0, (n + 1) * size, max(size, 1), dtype=np.int32)[: n + 1] if size else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Matrix of what ``packed`` gives."""
    return flat(column, kind)[0].reshape(len(column), width)


def flat(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of binary values in a row, and the n + 1 bounds of the values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes() if data.ctypes.data % size else data, kind), (offsets - offsets[0]) // size


#: Steps of the numbers that are written in three bytes: whole numbers, and decimals of six places.
STEPS = (1.0, 1e6)


def coded(values: np.ndarray, widths: tuple[int, ...]) -> pa.Array:
    """Rows of vectors (of ``widths``, side by side) as binary values that ``decoded`` turns into unit vectors.

    Rows of whole numbers or short decimals take three bytes a number, plane by plane, which compress well; from these the
    unit vectors come out bit by bit as from the numbers themselves. Other rows hold their unit vectors.
    """
    out: list[bytes] = [b""] * len(values)
    left = np.arange(len(values))
    for kind, step in enumerate(STEPS, 1):
        part = values[left]
        with np.errstate(over="ignore"):
            whole = np.rint(part * step)
        fits = ((whole >= 0) & (whole < 2**24) & (whole / step == part)).all(1)
        planes = np.ascontiguousarray(whole[fits].astype("<u4").view(np.uint8).reshape(int(fits.sum()), values.shape[1], 4)[:, :, 2::-1].transpose(0, 2, 1)) if fits.any() else []
        for i, row in zip(left[fits], planes, strict=True):
            out[i] = bytes([kind]) + row.tobytes()
        left = left[~fits]
    for i, row in zip(left, units(values[left], widths), strict=True):
        out[i] = b"\0" + row.tobytes()
    return pa.array(out, pa.binary())


def as_is(vectors: np.ndarray) -> pa.Array:
    """Binary values from which ``decoded`` gives these very numbers."""
    return packed(np.concatenate((np.zeros((len(vectors), 1), np.uint8), np.ascontiguousarray(vectors, np.float64).view(np.uint8)), 1))


def decoded(column: pa.ChunkedArray | pa.Array, widths: tuple[int, ...]) -> np.ndarray:
    """Unit vectors out of what ``coded`` gives."""
    width = sum(widths)
    data, bounds = flat(column, np.uint8)
    out = np.empty((len(bounds) - 1, width))
    kinds = data[bounds[:-1]]
    for kind, step in enumerate((None, *STEPS)):
        rows = np.flatnonzero(kinds == kind)
        if not len(rows):
            continue
        size = width * (8 if step is None else 3)
        part = data[(bounds[rows] + 1)[:, None] + np.arange(size)]
        if step is None:
            out[rows] = part.view(np.float64)
        else:
            high, middle, low = (part[:, i * width : (i + 1) * width].astype(np.float64) for i in range(3))
            out[rows] = units((high * 65536 + middle * 256 + low) / step, widths)
    return out


def units(values: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """Vectors side by side, each scaled to length 1."""
    ends = np.cumsum(widths)
    return np.concatenate([unit(np.ascontiguousarray(values[:, e - w : e])) for w, e in zip(widths, ends, strict=True)], 1)


def usable(df: DataFrame, key: str, vectors: dict[str, int], codes: bool = False) -> DataFrame:
    """Columns n, digest and each of ``vectors`` (name: width) of the rows in which all of them can be used.

    With ``codes`` one column vec holds all vectors side by side, as ``coded``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: matrix(batch.column(i + 1), width) for i, (name, width) in enumerate(vectors.items())}
            rows = None
            for at, _ in found.values():
                rows = at if rows is None else np.intersect1d(rows, at)
            kept = [values[np.searchsorted(at, rows)] for at, values in found.values()]
            whole = np.ascontiguousarray(np.concatenate(kept, 1)) + 0.0  # one kind of zero
            digests = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in whole]
            columns = [coded(whole, tuple(vectors.values()))] if codes else map(rows_of, kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(digests, pa.binary()), *columns], names=["n", "digest", *names])

    kind = df.schema[key].dataType.simpleString()
    names = ["vec"] if codes else list(vectors)
    schema = f"n {kind}, digest binary, " + ", ".join(f"`{name}` {'binary' if codes else 'array<double>'}" for name in names)
    return df.select(F.col(key).alias("_n"), *vectors).where("_n is not null").mapInArrow(run, schema)


def classes(rows: DataFrame, first: int) -> DataFrame:
    """Columns digest, head, firsts: the ``first`` smallest n of each class of equal vectors, ascending; head is the least.

    Only that many rows of a class leave a partition, so a class of any size costs its task no more than the others.
    """
    order = Window.partitionBy("digest").orderBy("n")
    few = rows.select("n", "digest").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first)
    lists = few.groupBy("digest").agg(F.sort_array(F.collect_list("n")).alias("firsts"))
    return lists.select("digest", F.col("firsts")[0].alias("head"), "firsts")
