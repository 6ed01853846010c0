"""FASTA and FASTQ as Spark data: a data source for files (plain or gzip), and entries for streams and lists."""

from __future__ import annotations

import fnmatch
import gzip
import io
import re
import sys
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

SCHEMA = "n bigint, id string, seq string, file string, error string"
_ARROW = pa.schema([("n", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("file", pa.string()), ("error", pa.string())])
_FASTA, _FASTQ = (".fasta", ".fa", ".fna"), (".fastq", ".fq")
#: Characters of sequence in a batch.
BATCH = 1 << 22
#: Bytes of a plain file that one task reads (option ``splitBytes``).
SPLIT = 64 << 20
#: Bits of n that count the records of one task; the bits above number the tasks.
PLACE_BITS = 33


class MalformedRecord(ValueError):
    """A record that breaks its format."""


def format_of(path: str) -> str | None:
    """``fasta`` or ``fastq`` by the extension, ``.gz`` endings aside; None if it is neither. Case matters."""
    while path.endswith(".gz"):
        path = path[:-3]
    return "fastq" if path.endswith(_FASTQ) else "fasta" if path.endswith(_FASTA) else None


def format_column(path: Column) -> Column:
    """``format_of`` for a column of file names."""
    name = F.regexp_replace(path, r"(\.gz)+$", "")
    ends = lambda endings: name.rlike("(" + "|".join(endings).replace(".", r"\.") + ")$")
    return F.when(ends(_FASTQ), "fastq").when(ends(_FASTA), "fasta")


def sniff(start: str) -> str | None:
    """Format by the first character: ``>`` means FASTA, anything else FASTQ; None for an empty text."""
    return None if not start else "fasta" if start[0] == ">" else "fastq"


def _ascii(text: str) -> str:
    """Every character beyond ASCII becomes N, so that offsets are the same in bytes and characters."""
    return text if text.isascii() else "".join(c if c < "\x80" else "N" for c in text)


def _name(head: str) -> str:
    words = head.split(None, 1)
    return words[0] if words and not head[:1].isspace() else ""


def read_fasta(lines: Iterable[str]) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(id, seq, error) of each record; bodies over several lines are joined. Text before the first header is an error."""
    name, body = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield name, _ascii("".join(body)), None
            name, body = _name(line[1:]), []
        elif name is not None:
            body.append(line.strip())
        elif line.strip():
            yield None, None, "text before the first header"
    if name is not None:
        yield name, _ascii("".join(body)), None


def read_fastq(lines: Iterable[str]) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(id, seq, error) of each record; qualities are read by their length, so they may begin with any character."""
    lines = iter(lines)
    for head in lines:
        head = head.rstrip("\r\n")
        if not head:
            continue
        if not head.startswith("@"):
            yield None, None, "header does not start with @"
            continue
        body, quality, mark = [], 0, False
        for line in lines:
            line = line.rstrip("\r\n")
            if line.startswith("+"):
                mark = True
                break
            body.append(line.strip())
        seq = _ascii("".join(body))
        lacking = len(seq)
        while mark and quality < lacking:
            line = next(lines, None)
            if line is None:
                break
            quality += len(line.rstrip("\r\n"))
        if mark and lacking == 0:
            next(lines, None)  # the empty quality line
        error = None if mark and quality == lacking else "no separator line" if not mark else "quality and sequence differ in length"
        yield (_name(head[1:]), seq, None) if error is None else (None, None, error)


def read_records(lines: Iterable[str], form: str) -> Iterator[tuple[str | None, str | None, str | None]]:
    return read_fasta(lines) if form == "fasta" else read_fastq(lines)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """Storage that a path is on, and its place there: local, or whatever Arrow can reach (s3a, hdfs, gs, abfs and more)."""
    scheme, found, rest = path.partition(":")
    if not found or len(scheme) == 1 or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def files_of(path: str, known: bool = False) -> list[tuple[str, int]]:
    """Files that a path, folder or pattern names, with their sizes, sorted. A pattern may stand in the last part only.

    known: of a folder only the files whose extension names a format.
    """
    store, place = _store(path)
    folder, _, last = place.rpartition("/")
    prefix = path[: len(path) - len(place)] if path.endswith(place) else path.partition(":")[0] + "://"
    magic = any(c in last for c in "*?[")
    info = store.get_file_info(place) if not magic else None
    if info is not None and info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info is not None and info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    listed = store.get_file_info(pafs.FileSelector(folder or "." if magic else place, allow_not_found=True))
    keep = (lambda f: fnmatch.fnmatch(f.base_name, last)) if magic else (lambda f: not f.base_name.startswith((".", "_")) and (not known or format_of(f.base_name)))
    found = sorted((prefix + f.path, f.size) for f in listed if f.type == pafs.FileType.File and keep(f))
    if magic and not found:
        raise FileNotFoundError(path)
    return found


def delete_file(path: str) -> None:
    store, place = _store(unquote(path))
    store.delete_file(place)


def open_text(path: str, begin: int = 0) -> io.TextIOBase:
    """Opens a file for reading from a byte on; all members of a ``.gz`` file are read."""
    store, place = _store(path)
    raw = store.open_input_file(place)
    raw.seek(begin)
    data = io.BufferedReader(raw, 1 << 20)
    return io.TextIOWrapper(gzip.open(data) if path.endswith(".gz") else data, encoding="utf-8", errors="replace", newline="\n")


class _Part(InputPartition):
    def __init__(self, number: int, path: str, form: str, begin: int, end: int | None):
        self.number, self.path, self.form, self.begin, self.end = number, path, form, begin, end


def _lines_of(path: str, form: str, begin: int, end: int) -> Iterator[str]:
    """Lines of the records that begin within bytes ``begin`` to ``end`` of a plain file.

    FASTA records begin at a line with ``>``. FASTQ files this large must have four lines a record: one begins at a line
    with ``@`` of which the next but one begins with ``+``, which no quality line in place of a header can meet.
    """
    store, place = _store(path)
    with store.open_input_file(place) as raw:
        at = max(0, begin - 1)
        raw.seek(at)
        data = io.BufferedReader(raw, 1 << 20)
        if begin:
            at += len(data.readline())  # the rest of a line that began earlier
        held: list[bytes] = []
        started = begin == 0
        place_of = at  # where the first held line begins
        for line in iter(data.readline, b""):
            held.append(line)
            if form == "fasta":
                if line.startswith(b">"):
                    if place_of >= end:
                        return
                    started = True
                if started:
                    yield line.decode("utf-8", "replace")
                place_of += len(line)
                held.clear()
                continue
            if not started and len(held) == 3 and not (held[0].startswith(b"@") and held[2].startswith(b"+")):
                place_of += len(held.pop(0))
                continue
            if len(held) == 3 and not started:
                started = True
            if started and len(held) == 4:
                if place_of >= end:
                    return
                if not held[0].startswith(b"@") or not held[2].startswith(b"+"):
                    raise MalformedRecord(f"{path}, byte {place_of}: a FASTQ file of several tasks needs four lines a record")
                yield from (x.decode("utf-8", "replace") for x in held)
                place_of += sum(map(len, held))
                held.clear()
        if started and held and place_of < end:
            yield from (x.decode("utf-8", "replace") for x in held)


class FastxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.form = options.get("fileformat", "auto").lower()
        self.mode = options.get("mode", "FAILFAST").upper()
        self.split = int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path, size in files_of(self.path, self.form == "auto"):
            form = format_of(path) if self.form == "auto" else self.form
            whole = form not in ("fasta", "fastq") or path.endswith(".gz") or size <= self.split
            for begin in [0] if whole else range(0, size, self.split):
                parts.append(_Part(len(parts), path, form or "sniff", begin, None if whole else begin + self.split))
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        path, form = partition.path, partition.form
        whole = partition.end is None
        lines = open_text(path) if whole else _lines_of(path, form, partition.begin, partition.end)
        if form == "sniff":
            first = next(iter(lines), "")
            form, lines = sniff(first), _again(first, lines)
        if form is None:
            return
        rows, size, n = [], 0, partition.number << PLACE_BITS
        for name, seq, error in read_records(lines, form):
            if error is not None and self.mode == "FAILFAST":
                raise MalformedRecord(f"{path}, record {n & ((1 << PLACE_BITS) - 1)}: {error}")
            if error is not None and self.mode == "DROPMALFORMED":
                n += 1
                continue
            rows.append((n, name, seq, path, error))
            n, size = n + 1, size + len(seq or "")
            if size > BATCH or len(rows) >= 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _again(first: str, rest: Iterable[str]) -> Iterator[str]:
    yield first
    yield from rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FastxSource(DataSource):
    """``spark.read.format("fastx").load(path)``: n, id, seq, file, error.

    n is unique and ascends in order of files and of records within them. The first task's records are numbered from 0
    (so those of a single small file are 0, 1, 2 and so on); each further task starts at a multiple of 2^33, as with
    ``monotonically_increasing_id``. ``dense_numbers`` closes the gaps. A gzip file is one task; a plain file has a task
    for each ``splitBytes``, whatever storage it is on.

    Options: fileFormat ``auto`` (by extension, else by the first character), ``fasta``, ``fastq`` or ``sniff``; mode
    ``FAILFAST`` (default), ``PERMISSIVE`` (a malformed record becomes a row with its error) or ``DROPMALFORMED``;
    splitBytes. FASTQ files above it need four lines a record, smaller ones may wrap. Descriptions and qualities are not
    kept. An empty file gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def read_fastx(spark: SparkSession, path: str, form: str = "auto", mode: str = "FAILFAST", split: int = SPLIT) -> DataFrame:
    """Sequences of a file, folder or pattern."""
    register(spark)
    return spark.read.format("fastx").option("fileFormat", form).option("mode", mode).option("splitBytes", split).load(path)


def dense_numbers(df: DataFrame) -> DataFrame:
    """The same rows with n counted from 0 without gaps, in the same order. Records are counted for each task first."""
    task = F.shiftright("n", PLACE_BITS).alias("_task")
    counts = df.groupBy(task).agg(F.count("*").alias("_rows"), F.min("n").alias("_first"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = counts.select("_task", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return df.withColumn("_task", task).join(starts, "_task").withColumn("n", F.col("n") - F.col("_first") + F.col("_start")).select(df.columns)


def read_stream(spark: SparkSession, stream: Iterable[str] | None = None) -> DataFrame:
    """Sequences of an open text stream (standard input by default); the format shows in its first character."""
    lines = iter(sys.stdin if stream is None else stream)
    first = next(lines, "")
    form = sniff(first)
    rows = [] if form is None else [(n, *r) for n, r in enumerate(read_records(_again(first, lines), form))]
    bad = next((r for r in rows if r[3] is not None), None)
    if bad is not None:
        raise MalformedRecord(f"stream, record {bad[0]}: {bad[3]}")
    return spark.createDataFrame([r[:3] for r in rows], "n bigint, id string, seq string")


def from_list(spark: SparkSession, sequences: list[str]) -> DataFrame:
    """Sequences of a list: n is the place in it."""
    return spark.createDataFrame(list(enumerate(sequences)), "n bigint, seq string")
