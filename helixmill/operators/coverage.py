"""Coverage histograms: how frequent in a collection the k-mers of each sequence are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..kernels import check_k, kmers, stretches, tally
from .counter import kmer_counts
from .kmers import kind_of, scan


def sequence_kmers(df: DataFrame, k: int, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, kmer, times: the canonical k-mers of each sequence, counted within it."""
    check_k(k)

    def rows_of(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for code, bounds, rows, _, _ in stretches(texts, k):
            at, forward, reverse = kmers(code, bounds, k)
            owner = np.searchsorted(bounds, at, "right") - 1
            owner, value, times = tally(owner, np.minimum(forward, reverse).astype(np.int64), k)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[owner])), pa.array(value), pa.array(times)], names=[key, "kmer", "times"])

    return scan(df, key, seq, rows_of, f"`{key}` {kind_of(df, key)}, kmer bigint, times bigint")


def coverage_histograms(df: DataFrame, k: int = 15, bin_size: int = 16, bin_count: int = 16, norm: bool = True, counts: DataFrame | None = None, alt: DataFrame | None = None, key: str = "n", seq: str = "seq") -> DataFrame:
    """Columns ``key``, bin_count (array<double>): for each sequence how many of its k-mers fall into each frequency bin.

    Frequencies come from ``counts`` (kmer, count), else from the sequences of ``alt``, else from ``df`` itself. A k-mer
    that isn't counted has 0; the last bin is open-ended; with ``norm`` a histogram is divided by its sum. There is one row
    for each key, all zero where there is no k-mer; rows that share a key add up; rows without a key are left out.

    k-mers are counted within each sequence and exchanged by k-mer. Where the frequencies are those of ``df`` itself, they
    are added up over the same exchange, so texts are cut once and k-mers move once; a k-mer of many sequences is a stream of
    narrow rows there, never a group in memory. Else the counts are joined, broadcast by Spark itself where they are small.
    """
    rows = df.where(F.col(key).isNotNull())
    mine = sequence_kmers(rows, k, key, seq)
    if counts is None and alt is None:
        mine = mine.repartition("kmer")
        counts = mine.groupBy("kmer").agg(F.sum("times").alias("count"))
    counts = counts if counts is not None else kmer_counts(alt, k, seq)
    mine = mine.join(counts.select("kmer", "count"), "kmer", "left")
    binned = mine.select(key, "times", codec.bucket(F.col("count"), bin_size, bin_count).alias("_bin"))
    every = binned.unionByName(rows.select(key, F.lit(0).cast("bigint").alias("times"), F.lit(0).alias("_bin")))
    bins = [F.sum(F.when(F.col("_bin") == i, F.col("times")).otherwise(F.lit(0))).cast("double") for i in range(bin_count)]
    out = every.groupBy(key).agg(F.array(*bins).alias("bin_count"), F.sum("times").cast("double").alias("_all"))
    values = F.transform("bin_count", lambda x: codec.share(x, F.col("_all"))) if norm else F.col("bin_count")
    return out.select(key, values.alias("bin_count"))
