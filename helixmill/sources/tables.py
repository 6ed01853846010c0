"""Text forms of results, to be written and read again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters by name.
DELIMITERS = {"csv": ",", "tsv": "\t", "spc": " "}


def plain(x: float) -> str:
    """Shortest decimal that reads back as the same number, without exponent and without a needless point."""
    return np.format_float_positional(x, trim="-")


def six(x: float) -> str:
    """Six decimals, exact ties to even."""
    return f"{x:.6f}"


def _lines(column: Column, line_of: Callable[[object], str]) -> Column:
    @F.pandas_udf("string")
    def lines(values: pd.Series) -> pd.Series:
        return values.map(line_of)

    return lines(column)


def vector_lines(df: DataFrame, column: str, norm: bool = True, preset: str = "spc", order: str = "n") -> DataFrame:
    """Columns _order, line: the vector's values joined; six decimals if normalised, plain numbers else."""
    sep, form = DELIMITERS[preset], six if norm else plain
    return df.select(F.col(order).alias("_order"), _lines(F.col(column), lambda v: sep.join(map(form, v))).alias("line"))


def path_lines(df: DataFrame, column: str = "path", order: str = "n") -> DataFrame:
    """Columns _order, line: points as ``(x,y)``, weighted ones as ``(x,y,f)``, apart by a blank."""
    names = [f.name for f in df.schema[column].dataType.elementType.fields]
    return df.select(F.col(order).alias("_order"), _lines(F.col(column), lambda v: " ".join("(" + ",".join(plain(p[n]) for n in names) + ")" for p in v)).alias("line"))


def span_lines(df: DataFrame, name: str = "id", order: str = "n", trailing_tab: bool = True) -> DataFrame:
    """Columns _order, line of ``sequences_to_minimisers``: name and ``MIN:start-end`` for each span, apart by tabs."""
    parts = F.transform("spans", lambda s: F.concat(s["minimiser"], F.lit(":"), s["span_start"], F.lit("-"), s["span_end"]))
    line = F.array_join(F.concat(F.array(F.coalesce(F.col(name).cast("string"), F.lit(""))), parts), "\t")
    return df.select(F.col(order).alias("_order"), (F.concat(line, F.lit("\t")) if trailing_tab else line).alias("line"))


def member_lines(df: DataFrame, name: str = "id") -> DataFrame:
    """Columns _order, line of ``minimisers_to_sequences``: minimiser, tab, list of ``("id", start, end)``."""
    quoted = lambda m: F.concat(F.lit('("'), F.replace(F.replace(m[name].cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('", '), m["span_start"], F.lit(", "), m["span_end"], F.lit(")"))
    line = F.concat(F.col("minimiser"), F.lit("\t["), F.array_join(F.transform("members", quoted), ", "), F.lit("]"))
    return df.select(F.col("minimiser").alias("_order"), line.alias("line"))


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None, preset: str = "spc") -> None:
    """Writes ``line`` in order of ``_order`` as a folder of text parts; their names keep the order, a header is part of the first."""
    rows = lines.orderBy("_order").select("line")
    if header is not None:
        head = lines.sparkSession.createDataFrame([(DELIMITERS[preset].join(header),)], "line string").coalesce(1)
        rows = head.union(rows)
    rows.write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str, header: list[str] | None = None, preset: str = "spc") -> None:
    """As ``write_lines`` into one local file, row by row through the driver: for results that fit one disk."""
    with open(path, "w", encoding="utf-8") as out:
        if header is not None:
            out.write(DELIMITERS[preset].join(header) + "\n")
        for row in lines.orderBy("_order").select("line").toLocalIterator(prefetchPartitions=True):
            out.write(row["line"] + "\n")


def count_lines(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("kmer").alias("_order"), F.concat(F.col("kmer").cast("string"), F.lit("\t"), F.col("count")).alias("line"))


def write_counts(counts: DataFrame, folder: str) -> None:
    """kmer and count, apart by a tab."""
    counts.select("kmer", "count").write.mode("overwrite").option("sep", "\t").csv(folder)


def write_partial_counts(df: DataFrame, folder: str, parts: int) -> None:
    """Partial counts by partition: a folder ``part_no=p`` for each remainder of the k-mer."""
    df.select("kmer", "count", F.pmod("kmer", F.lit(parts)).alias("part_no")).repartition("part_no").write.mode("overwrite").partitionBy("part_no").option("sep", "\t").csv(folder)


def write_spilled(df: DataFrame, folder: str) -> None:
    """Partial counts (part_no, chunk_no, kmer, cnt) as text, apart by partition and chunk."""
    df.select("kmer", "cnt", "part_no", "chunk_no").write.mode("overwrite").partitionBy("part_no", "chunk_no").option("sep", "\t").csv(folder)


#: Where a partial count file's path says its partition and chunk: ``...part_p_chunk_c``, or folders ``part_no=p/chunk_no=c``.
SPILLED = r"part_(?:no=)?(\d+)[/_]chunk_(?:no=)?(\d+)"


def read_spilled(spark: SparkSession, path: str) -> DataFrame:
    """Columns part_no, chunk_no, kmer, cnt of partial counts: a folder of ``write_spilled``, or a pattern of single files."""
    rows = spark.read.schema("kmer bigint, cnt bigint").option("sep", "\t").option("recursiveFileLookup", "true").csv(path)
    place = lambda i: F.regexp_extract("_metadata.file_path", SPILLED, i).cast("int")
    return rows.select(place(1).alias("part_no"), place(2).alias("chunk_no"), "kmer", "cnt")


def merge_spilled(spark: SparkSession, path: str, out: str, k: int, acgt: bool = False, delete: bool = False) -> None:
    """Merges partial counts into the folder ``out``, every row counted; with ``delete`` the files read go afterwards."""
    from ..operators.counter import merge_counts
    from .fastx import delete_file

    rows = read_spilled(spark, path)
    files = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()] if delete else []  # a name for each spilled file
    write_counts(merge_counts(rows, k, acgt, once=False), out)
    for file in files:
        delete_file(file)


def read_counts(spark: SparkSession, path: str, acgt: bool = False) -> DataFrame:
    """Counts as written above."""
    return spark.read.schema(f"kmer {'string' if acgt else 'bigint'}, count bigint").option("sep", "\t").csv(path)


def delete_if_exists(path: str) -> None:
    """Removes a file; no error if there is none."""
    import os

    if os.path.exists(path):
        os.remove(path)


def make_folder(path: str) -> None:
    import os

    os.makedirs(path, exist_ok=True)


def sorted_lines(path: str) -> list[str]:
    """Trimmed lines of a text file, or of a folder of text parts, in order."""
    import os

    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")] if os.path.isdir(path) else [path]
    return sorted(line.strip() for f in files for line in open(f, encoding="utf-8"))
