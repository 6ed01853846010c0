"""k-mer counts of a growing collection of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counter import kmer_counts


def sequence_stream(spark: SparkSession, folder: str, schema: str = "n bigint, id string, seq string, read_at timestamp", files: int = 16) -> DataFrame:
    """Sequences of the Parquet files that arrive in a folder, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def running_counts(sequences: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, count of all that has arrived; for the output modes ``update`` and ``complete``."""
    return kmer_counts(sequences, k, seq)


def windowed_stats(sequences: DataFrame, time: str = "read_at", width: str = "1 day", late: str = "7 days", seq: str = "seq") -> DataFrame:
    """window_start, seq_count, total_length by time of reading; rows later than ``late`` are left out."""
    rows = sequences.select(F.col(time).cast("timestamp").alias("_time"), F.length(seq).alias("_size")).withWatermark("_time", late)
    stats = rows.groupBy(F.window("_time", width).alias("w")).agg(F.count("*").alias("seq_count"), F.coalesce(F.sum("_size"), F.lit(0)).alias("total_length"))
    return stats.select(F.col("w.start").alias("window_start"), "seq_count", "total_length")
