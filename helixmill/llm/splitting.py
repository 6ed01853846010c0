"""Cutting oversized sequences and texts into pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A gap of an assembly: at least ten characters in a row that are no base.
ASSEMBLY_GAP = "[^ACGTUacgtu]{10,}"


def boundaries(text: str, pattern: re.Pattern) -> list[int]:
    """Ends of the pattern's matches, ascending.

    Matches and what lies between them are the tokens; prefix sums of the tokens' lengths are their offsets, and every
    other offset ends a match.
    """
    edges = [0]
    for match in pattern.finditer(text):
        edges += match.span()
    return np.cumsum(np.diff(edges))[1::2].tolist()


def cut(length: int, ends: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of 0..length, each at most ``limit`` long.

    While more than ``limit`` is left, a piece ends at the last of ``ends`` (sorted) that is within the limit and more
    than ``overlap`` past its start, found by binary search, or else at the limit; the next one starts ``overlap``
    earlier. Without a boundary for long the cuts fall at the limit.
    """
    pieces, start = [], 0
    while length - start > limit:
        at = bisect_right(ends, start + limit) - 1
        end = ends[at] if at >= 0 and ends[at] > start + overlap else start + limit
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, length))
    return pieces


def split_oversized(df: DataFrame, key: str = "n", text: str = "seq", limit: int = 1000, overlap: int = 50, pattern: str = ASSEMBLY_GAP, pieces: bool = False) -> DataFrame:
    """Columns ``key``, piece_no, piece_start, piece_end of every text longer than ``limit`` characters.

    Offsets count characters from 0, end exclusive; piece_no counts from 1. With ``pieces`` the column piece holds the
    text of each piece. Null, empty and short texts have no row; repeated rows come out as often as they came in; an
    empty table gives an empty table; further columns are left aside. One pass without a shuffle: the length filter runs
    before Python, so only long texts go there, and a text's work is linear in its length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = re.compile(pattern)
        for batch in batches:
            rows, numbers, starts, ends, parts = [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for number, (start, end) in enumerate(cut(len(value), boundaries(value, rule), limit, overlap), 1):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    ends.append(end)
                    if pieces:
                        parts.append(value[start:end])
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int32()) for x in (numbers, starts, ends))]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(parts, pa.string())] if pieces else [])], names=names)

    names = [key, "piece_no", "piece_start", "piece_end", *(["piece"] if pieces else [])]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, piece_start int, piece_end int" + (", piece string" if pieces else "")
    return df.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text") > limit).mapInArrow(run, schema)
