"""Windowed minimisers: the smallest canonical m-mer of every window of w bases, as spans over which it stays the same.

A window counts if none of its bases is ambiguous. A span is a maximal run of consecutive windows with one minimiser; it
reaches from the first base of its first window to the last base of its last one (end exclusive), so spans overlap. A
window as wide as the sequence (w = 0) gives one minimiser for each sequence without an ambiguous base.

``compat`` follows an older implementation in two cases: a minimiser that only the very last window has is not reported
if other windows precede it without a break; and where the unambiguous end of a sequence has at least m but fewer than w
bases, a span over it is reported with a minimiser of m times T.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import AMBIGUOUS, check_k, codes, encode, sliding_min, stretches, text_of, window_starts
from .kmers import kind_of, kmer_windows, scan


@dataclass
class Spans:
    """Spans in a row: row of the text, minimiser code, start, end (exclusive)."""

    row: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray


def check(w: int, m: int) -> None:
    check_k(m, "m")
    if w < 0 or 0 < w < m:
        raise ValueError("w must be 0 or at least m")


def window_minima(code: np.ndarray, bounds: np.ndarray, w: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid windows of a block, and the minimiser of each."""
    at = window_starts(code, bounds, w)
    if not len(at):
        return at, np.zeros(0, np.int64)
    forward, reverse = encode(code, m)
    return at, sliding_min(np.minimum(forward, reverse).astype(np.int64), w - m + 1)[at]


def spans(texts: pa.Array, w: int, m: int, compat: bool = False) -> Spans:
    """Spans of all texts, by text and start."""
    check(w, m)
    if w == 0:
        return _whole(texts, m, compat)
    rows, values, firsts, lasts, sizes = [], [], [], [], []
    for code, bounds, row, begins, size in stretches(texts, w):
        at, value = window_minima(code, bounds, w, m)
        owner = np.searchsorted(bounds, at, "right") - 1
        new = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]))[: len(at)]
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        shift = begins[owner[heads]] - bounds[owner[heads]]
        for out, x in zip((rows, values, firsts, lasts, sizes), (row[owner[heads]], value[heads], at[heads] + shift, at[tails] + shift, size[owner[heads]]), strict=True):
            out.append(x)
    row, value, first, last, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, values, firsts, lasts, sizes))
    joins = np.zeros(len(row), bool)  # the parts of a long text meet within a span
    joins[1:] = (row[1:] == row[:-1]) & (first[1:] == last[:-1] + 1) & (value[1:] == value[:-1])
    heads = np.flatnonzero(~joins)
    row, value, size, first, last = row[heads], value[heads], size[heads], first[heads], last[np.append(heads[1:], len(last))[: len(heads)] - 1]
    end = last + w
    if compat:
        follows = np.zeros(len(row), bool)
        follows[1:] = (row[1:] == row[:-1]) & (first[1:] == last[:-1] + 1)
        keep = ~((end == size) & (first == last) & follows)
        row, value, first, end = row[keep], value[keep], first[keep], end[keep]
        row, value, first, end = _with_tails(texts, m, w, row, value, first, end)
    return Spans(row, value, first, end)


def _tails(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start of the unambiguous end of each text, and the texts' lengths."""
    code, bounds = codes(texts)
    bad = np.flatnonzero(code == AMBIGUOUS)
    last = np.searchsorted(bad, bounds[1:], "left") - 1
    place = np.where(last >= 0, bad[np.maximum(last, 0)] if len(bad) else -1, -1) if len(bad) else np.full(len(texts), -1)
    return np.maximum(place + 1, bounds[:-1]) - bounds[:-1], np.diff(bounds)


def _with_tails(texts, m, w, row, value, start, end):
    begin, size = _tails(texts)
    width = size if w == 0 else np.full(len(size), w)
    short = np.flatnonzero((size - begin >= m) & (size - begin < width))
    row, value = np.concatenate((row, short)), np.concatenate((value, np.full(len(short), 4**m - 1)))
    start, end = np.concatenate((start, begin[short])), np.concatenate((end, size[short]))
    order = np.lexsort((end, start, row))
    return row[order], value[order], start[order], end[order]


def _whole(texts: pa.Array, m: int, compat: bool) -> Spans:
    begin, size = _tails(texts)
    best = np.full(len(texts), np.iinfo(np.int64).max)
    for code, bounds, rows, _, _ in stretches(texts, m):
        at = window_starts(code, bounds, m)
        if len(at):
            forward, reverse = encode(code, m)
            np.minimum.at(best, rows[np.searchsorted(bounds, at, "right") - 1], np.minimum(forward, reverse)[at].astype(np.int64))
    row = np.flatnonzero((begin == 0) & (size >= m))
    out = row, best[row], np.zeros(len(row), np.int64), size[row]
    return Spans(*(_with_tails(texts, m, 0, *out) if compat else out))


def minimiser_spans(df: DataFrame, w: int = 0, m: int = 10, compat: bool = False, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, minimiser (text), span_start, span_end. Null, empty and short sequences have no row.

    One pass without a shuffle; the minimum slides by doubling, so a sequence costs its length times log w.
    """
    check(w, m)

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        s = spans(texts, w, m, compat)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(s.row)), text_of(s.value, m), pa.array(s.start.astype(np.int32)), pa.array(s.end.astype(np.int32))], names=[key, "minimiser", "span_start", "span_end"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, minimiser string, span_start int, span_end int")


def sequences_to_minimisers(df: DataFrame, w: int = 0, m: int = 10, compat: bool = False, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, spans (array of minimiser, span_start, span_end in order): one row for each input row."""
    check(w, m)
    kind = pa.struct([("minimiser", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        s = spans(texts, w, m, compat)
        items = pa.StructArray.from_arrays([text_of(s.value, m), pa.array(s.start.astype(np.int32)), pa.array(s.end.astype(np.int32))], fields=list(kind))
        offsets = pa.array(np.searchsorted(s.row, np.arange(len(texts) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, items)], names=[key, "spans"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, spans array<struct<minimiser: string, span_start: int, span_end: int>>")


def minimisers_to_sequences(df: DataFrame, w: int = 0, m: int = 10, compat: bool = False, key: str = "n", seq: str = "seq", chunk: int | None = None) -> DataFrame:
    """Columns minimiser, members (array of ``key``, span_start, span_end in order): the sequences of each minimiser.

    With ``chunk`` a minimiser held by many sequences comes in several rows of at most that many members each, numbered
    by the column chunk_no: the bins of frequent minimisers then stay bounded, and no task gathers one as a whole.
    """
    rows = minimiser_spans(df, w, m, compat, key, seq)
    member = F.struct(key, "span_start", "span_end")
    if chunk is None:
        return rows.groupBy("minimiser").agg(F.sort_array(F.collect_list(member)).alias("members"))
    from .skew import chunked

    numbered = chunked(rows, "minimiser", [key, "span_start", "span_end"], chunk)
    return numbered.groupBy(F.col("_key").alias("minimiser"), F.col("_chunk").alias("chunk_no")).agg(F.sort_array(F.collect_list(member)).alias("members"))


def kmer_minimisers(df: DataFrame, w: int, m: int, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, pos, kmer (canonical text of w bases), minimiser: each valid window with its minimiser.

    A window that brings a new minimiser is listed under the one before it, if that window is its direct neighbour.
    """
    check(w, m)
    check_k(w, "w")

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for code, bounds, rows, begins, _ in stretches(texts, w + 1):  # one more, to know the window before
            at, value = window_minima(code, bounds, w, m)
            owner = np.searchsorted(bounds, at, "right") - 1
            known = np.append(False, (owner[1:] == owner[:-1]) & (at[1:] == at[:-1] + 1))[: len(at)]
            listed = value.copy()
            listed[1:][known[1:]] = value[:-1][known[1:]]
            place = at - bounds[owner] + begins[owner]
            own = ~((begins[owner] > 0) & (place == begins[owner]))  # the part before has this window as well
            forward, reverse = encode(code, w)
            kmer = np.minimum(forward, reverse)[at[own]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[owner[own]])), pa.array(place[own].astype(np.int32)), text_of(kmer, w), text_of(listed[own], m)], names=[key, "pos", "kmer", "minimiser"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, pos int, kmer string, minimiser string")


def minimiser_spans_sql(df: DataFrame, w: int, m: int, key: str = "n", seq: str = "seq") -> DataFrame:
    """As ``minimiser_spans`` by built-in expressions and window functions alone; keys must be unique."""
    from pyspark.sql.window import Window

    check(w, m)
    by_place = Window.partitionBy(key).orderBy("pos")
    frame = by_place.rangeBetween(0, w - m)  # of the places whose m-mer is unambiguous
    words = kmer_windows(df, m, key, seq)
    best = words.select(key, "pos", F.min("kmer").over(frame).alias("v"), F.count("*").over(frame).alias("_n")).where(F.col("_n") == w - m + 1)
    new = ~(F.lag("pos").over(by_place).eqNullSafe(F.col("pos") - 1) & F.lag("v").over(by_place).eqNullSafe(F.col("v")))
    runs = best.select(key, "pos", "v", new.cast("int").alias("_new")).withColumn("_run", F.sum("_new").over(by_place))
    out = runs.groupBy(key, "_run").agg(F.min("v").alias("minimiser"), F.min("pos").cast("int").alias("span_start"), (F.max("pos") + w).cast("int").alias("span_end"))
    return out.drop("_run")
