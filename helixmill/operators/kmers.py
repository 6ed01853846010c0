"""k-mers of sequences: generators, positions of vectors, canonical forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..kernels import check_k, kmers, stretches
from ..session import spread


#: Windows of a stretch when built-in expressions cut a sequence.
STRETCH = 512


def scan(df: DataFrame, key: str, seq: str, rows_of, schema: str) -> DataFrame:
    """Runs ``rows_of`` (Arrow key column, Arrow text column -> record batches) over two columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of(batch.column(0), batch.column(1))

    return spread(df.select(F.col(key).alias("_key"), F.col(seq).cast("string").alias("_seq"))).mapInArrow(run, schema)


def kind_of(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def kmer_pairs(df: DataFrame, k: int, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, pos, fwd, rev: each window of k bases without an ambiguous letter, as codes of both strands."""
    check_k(k)

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for code, bounds, rows, begins, _ in stretches(texts, k):
            at, forward, reverse = kmers(code, bounds, k)
            owner = np.searchsorted(bounds, at, "right") - 1
            place = at - bounds[owner] + begins[owner]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[owner])), pa.array(place.astype(np.int32)), pa.array(forward.astype(np.int64)), pa.array(reverse.astype(np.int64))], names=[key, "pos", "fwd", "rev"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, pos int, fwd bigint, rev bigint")


def kmer_windows(df: DataFrame, k: int, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, pos, kmer (canonical text): the same windows by built-in expressions alone.

    Long sequences are cut into overlapping stretches first, for a place in a text is found by counting from its start.
    """
    check_k(k)
    plain = spread(df.select(F.col(key), codec.normalise(F.col(seq)).alias("_s"))).where(F.length("_s") >= k)
    begins = plain.select(F.col(key), "_s", F.explode(F.sequence(F.lit(0), F.length("_s") - k, F.lit(STRETCH))).alias("_b"))
    parts = begins.select(F.col(key), "_b", F.substring(F.col("_s"), F.col("_b") + 1, F.lit(STRETCH + k - 1)).alias("_p"))
    windows = F.transform(F.sequence(F.lit(0), F.length("_p") - k), lambda i: F.substring(F.col("_p"), i + 1, F.lit(k)))
    exploded = parts.select(F.col(key), "_b", F.posexplode(windows).alias("_i", "_f")).where(codec.is_clean(F.col("_f")))
    return exploded.select(F.col(key), (F.col("_b") + F.col("_i")).alias("pos"), codec.canonical(F.col("_f")).alias("kmer"))


def vector_positions(spark: SparkSession, k: int, canonical_only: bool = True) -> DataFrame:
    """Columns pos, code, kmer: the k-mers that a composition vector has, in order of code, numbered from 0.

    Without ``canonical_only`` there is one position for each of the 4^k forward k-mers.
    """
    check_k(k)
    codes = position_codes(k, canonical_only)
    rows = spark.createDataFrame(_indexed(codes), "pos int, code bigint")
    return rows.select("pos", "code", codec.decode(F.col("code"), k).alias("kmer"))


def _indexed(codes: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"pos": np.arange(len(codes), dtype=np.int32), "code": codes})


#: Largest k with a table of all k-mers; beyond it only those that occur can be listed.
WIDEST_K = 12


def position_codes(k: int, canonical_only: bool = True) -> np.ndarray:
    """Codes of the positions of a composition vector."""
    check_k(k)
    if k > WIDEST_K:
        raise ValueError(f"a table of all k-mers needs k <= {WIDEST_K}; count k-mers in long form instead")
    codes = np.arange(4**k, dtype=np.int64)
    return codes[codes <= reverse_codes(codes, k)] if canonical_only else codes


def reverse_codes(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(codes)
    for _ in range(k):
        out = out << 2 | (codes & 3) ^ 3
        codes = codes >> 2
    return out


def header(k: int, canonical_only: bool = True) -> list[str]:
    """Names of a vector's positions."""
    return ["".join("ACGT"[int(c) >> 2 * i & 3] for i in range(k - 1, -1, -1)) for c in position_codes(k, canonical_only)]


def sequence_stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: seq_count, total_length (0 for an empty table; null sequences count with no length)."""
    return df.agg(F.count("*").alias("seq_count"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).cast("bigint").alias("total_length"))
