"""k-mer counts of a whole collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..kernels import check_k, kmers, stretches
from ..session import spread


def kmer_counts(df: DataFrame, k: int, seq: str = "seq", acgt: bool = False) -> DataFrame:
    """Columns kmer, count: how often each canonical k-mer occurs; kmer as code, or as text with ``acgt``.

    Every block is counted before it leaves the worker; the exchange carries one row for each k-mer of a block, Spark
    adds them up on both of its sides. Null, empty and short sequences add nothing.
    """
    check_k(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, bounds, _, _, _ in stretches(batch.column(0), k):
                _, forward, reverse = kmers(code, bounds, k)
                value, count = np.unique(np.minimum(forward, reverse), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(count)], names=["kmer", "part"])

    rows = spread(df.select(F.col(seq).cast("string").alias("_seq"))).where(F.length("_seq") >= k)
    parts = rows.mapInArrow(run, "kmer bigint, part bigint")
    return _named(parts.groupBy("kmer").agg(F.sum("part").alias("count")), k, acgt)


def merge_counts(parts: DataFrame, k: int, acgt: bool = False, once: bool = True) -> DataFrame:
    """Columns kmer, count out of spilled partial counts (part_no, chunk_no, kmer, cnt).

    With ``once`` a row that was written twice counts once. A null count adds nothing: a k-mer with nulls alone has 0.
    """
    rows = parts.select("part_no", "chunk_no", "kmer", "cnt").where("kmer is not null")
    rows = rows.distinct() if once else rows
    return _named(rows.groupBy("kmer").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("count")), k, acgt)


def _named(counts: DataFrame, k: int, acgt: bool) -> DataFrame:
    return counts.select(codec.decode(F.col("kmer"), k).alias("kmer"), "count") if acgt else counts
