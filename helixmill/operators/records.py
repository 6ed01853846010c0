"""Exported records, one a row or many in a text: typed records, and the lines that fail apart with reason and place.

The grammar is read by recursive descent::

    record := field ("," field)* end
    field  := '"' (any but '"' | '""')* '"'  |  (any but '"' and ",")*

An error in a record never stops the reader. In a text of many records it goes on at the next anchor: a line break after
which a record starts that can be read and is valid; so a quote that never closes costs no valid record, and each failing
record that stands between is reported with its own reason.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = 4
#: First reason that applies, in this order.
REASONS = ("quoting", "columns", "number", "id", "seq", "length")
#: Characters without a mark on paper that are in none of the categories Cc, Cf, Zs, Zl and Zp (fixed values of the
#: Unicode standard): default-ignorable letters and marks, and the blank Braille pattern.
UNSEEN = (
    (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x2800, 0x2800),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF),
)
_DIGITS = re.compile("[0-9]+")
_LETTERS = re.compile("[ACGTURYSWKMBDHVNacgturyswkmbdhvn]+")
_PLAIN = re.compile("[!-~]+")
_LARGEST = 2**63 - 1


@dataclass
class Fault(Exception):
    """A syntax or value error, with its reason, its place in the text and what was found there."""

    reason: str
    at: int
    detail: str


def unseen(text: str) -> int:
    """Place of the first character that is white space, a control or invisible; -1 if there is none."""
    if _PLAIN.fullmatch(text):
        return -1
    for i, c in enumerate(text):
        if c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp") or any(a <= ord(c) <= b for a, b in UNSEEN):
            return i
    return -1


class Reader:
    """Recursive-descent reader of one text. ``ends`` are the characters that end a record outside quotes."""

    def __init__(self, text: str, ends: str = ""):
        self.text, self.at = text, 0
        self.bare = re.compile(f'[^",{ends}]*')
        self.ends = ends

    def record(self) -> tuple[list[str], list[int]]:
        """Fields of the record that starts here and their places; leaves ``at`` on its end."""
        fields, places = [], []
        while True:
            places.append(self.at)
            fields.append(self.field())
            if self.at >= len(self.text) or self.text[self.at] in self.ends:
                return fields, places
            self.at += 1  # a comma: a field stops nowhere else

    def field(self) -> str:
        if self.text.startswith('"', self.at):
            return self.quoted()
        begin = self.at
        self.at = self.bare.match(self.text, begin).end()
        if self.text.startswith('"', self.at):
            raise Fault("quoting", self.at, "quote in an unquoted field")
        return self.text[begin : self.at]

    def quoted(self) -> str:
        begin, parts = self.at, []
        self.at += 1
        while True:
            close = self.text.find('"', self.at)
            if close < 0:
                raise Fault("quoting", begin, "quoted field does not close")
            parts.append(self.text[self.at : close])
            self.at = close + 1
            if not self.text.startswith('"', self.at):
                break
            parts.append('"')
            self.at += 1
        if self.at < len(self.text) and self.text[self.at] != "," and self.text[self.at] not in self.ends:
            raise Fault("quoting", self.at, "quoted field is followed by more")
        return "".join(parts)


def typed(fields: list[str], places: list[int]) -> tuple[int, str, str]:
    """(n, id, seq) of the fields of a record, or a fault."""
    if len(fields) != FIELDS:
        raise Fault("columns", 0, f"{len(fields)} fields")
    n, name, seq, length = fields
    for i in (0, 3):
        if not _DIGITS.fullmatch(fields[i]):
            raise Fault("number", places[i], "n" if i == 0 else "length")
    if not name:
        raise Fault("id", places[1], "empty")
    if (i := unseen(name)) >= 0:
        raise Fault("id", places[1], f"U+{ord(name[i]):04X}")
    if not seq:
        raise Fault("seq", places[2], "empty")
    if not _LETTERS.fullmatch(seq):
        raise Fault("seq", places[2], "other letters")
    digits = length.lstrip("0") or "0"
    if len(digits) > 18 or int(digits) != len(seq):
        raise Fault("length", places[3], f"{len(seq)} letters")
    return n, name, seq


def read_line(raw: str | None) -> tuple[int | None, str | None, str | None, str | None, int | None, str | None]:
    """(n, id, seq, reason, place, detail) of one record; the first three or the last three are null."""
    if raw is None:
        return None, None, None, "columns", 0, "null line"
    try:
        n, name, seq = typed(*Reader(raw).record())
    except Fault as f:
        return None, None, None, f.reason, f.at, f.detail
    digits = n.lstrip("0") or "0"
    return (int(digits) if len(digits) < 19 or len(digits) == 19 and int(digits) <= _LARGEST else None), name, seq, None, None, None


_BREAK = re.compile(r"[\r\n]")
_ANCHOR = re.compile(r"[\r\n]+(?=\"?[0-9]+\"?,)")


def read_text(text: str, base: int = 0, skipped: bool = False) -> Iterator[tuple[int, int | None, str | None, str | None, str | None, int | None, str | None]]:
    """Records of a text of many lines: (place of the record, n, id, seq, reason, place of the fault, detail).

    After a record of the wrong shape or value the reader goes on behind the record's end; after broken quoting, whose end
    isn't known, at the next anchor where a valid record starts, or else at the text's end. A record over several lines
    that is wrong in more than its id, or in which a valid record starts, is taken for broken quoting too. The lines skipped by that are
    read as a text of their own (``skipped``; ``base`` is its place), which goes on at the next line after broken quoting.
    """
    reader = Reader(text, "\r\n")
    while reader.at < len(text):
        if text[reader.at] in "\r\n":
            reader.at += 1
            continue
        begin = reader.at
        try:
            n, name, seq = typed(*reader.record())
            yield base + begin, *read_line(text[begin : reader.at])[:3], None, None, None
        except Fault as f:
            line = _BREAK.search(text, begin)
            line, own = (line.end(), text[begin : line.start()]) if line else (len(text), text[begin:])
            broken = f.reason == "quoting"
            if not broken and reader.at > line and (f.reason != "id" or _resume(text, begin, reader.at) < reader.at):
                alone, broken = read_line(own), True  # such a quote took other lines for its own
                f = Fault(*alone[3:]) if alone[3] else f
                f.at += begin if alone[3] else 0
            at = f.at if f.reason == "quoting" else f.at or begin
            yield base + begin, None, None, None, f.reason, base + at, f.detail
            if broken:
                reader.at = line if skipped else _resume(text, begin)
                yield from read_text(text[line : reader.at], base + line, True)


def _resume(text: str, begin: int, stop: int | None = None) -> int:
    """Next anchor with a valid record, before ``stop``. A valid record never holds a line break, so a probe ends with its line."""
    for anchor in _ANCHOR.finditer(text, begin, len(text) if stop is None else stop):
        line = _BREAK.search(text, anchor.end())
        try:
            typed(*Reader(text[anchor.end() : line.start() if line else len(text)]).record())
            return anchor.end()
        except Fault:
            continue
    return len(text)


def parse_records(df: DataFrame, key: str = "line_no", raw: str = "raw") -> DataFrame:
    """Columns ``key``, n, id, seq, reason, error_at, detail: every input row with its record or its fault.

    reason is null for valid records and one of ``REASONS`` else (a null line has ``columns``); error_at counts characters
    from 0. A valid n beyond BIGINT is null. Repeated rows are read each on its own, an empty table gives an empty one,
    further columns are left aside. One pass over two columns, no shuffle: valid and failing rows come out of it together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        for batch in batches:
            rows = [read_line(x) for x in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = [key, "n", "id", "seq", "reason", "error_at", "detail"]
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(raw).cast("string").alias("_raw")).mapInArrow(run, f"`{key}` {kind}, n bigint, id string, seq string, reason string, error_at int, detail string")


def parse_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """As ``parse_records`` for rows that hold whole texts of many lines; record_at is where a record starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1).to_pylist()):
                rows = list(read_text(value or ""))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *arrays], names=names)

    names = [key, "record_at", "n", "id", "seq", "reason", "error_at", "detail"]
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, record_at int, n bigint, id string, seq string, reason string, error_at int, detail string")
