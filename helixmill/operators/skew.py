"""Results for each key although a few keys hold most rows, by exact offset chunking.

Keys are counted in every input partition; prefix sums of these counts over the partitions give each partition the number
at which its rows of a key begin; so every row gets its number within its key, and a chunk is a run of ``chunk_rows``
numbers of one key. Chunks are equal in size whatever the key, and are processed apart; what they leave is a state with
its two boundaries, and the states of a key are merged in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

#: Rows of a chunk.
CHUNK_ROWS = 50_000


def chunked(df: DataFrame, key: str, keep: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns _key, the columns ``keep``, _number (from 0 within the key, in input order) and _chunk.

    Rows without a key are left out. Partition and place of every row are written down once, with the row: counts and rows
    come from that table, so they agree whatever stands before it (an exchange may cut its partitions otherwise each time
    it is planned or run again). Rows are then shuffled once, by input partition and key, so a task never holds more of a
    key than an input partition does.
    """
    tagged = df.select(F.col(key).alias("_key"), *[F.col(c) for c in keep], F.monotonically_increasing_id().alias("_at")).where("_key is not null")
    rows = materialise(tagged, "tagged").withColumn("_part", F.shiftright("_at", 33).cast("int"))  # the upper bits of _at
    counts = rows.groupBy("_part", "_key").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_key", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_part", "_key").orderBy("_at")
    numbered = rows.join(offsets.hint("shuffle_merge"), ["_part", "_key"]).withColumn("_number", F.col("_offset") + F.row_number().over(local) - 1)
    return numbered.select("_key", *keep, "_number", F.floor(F.col("_number") / chunk_rows).alias("_chunk"))


@dataclass
class Measures:
    """What to compute for each key.

    sums, least, most: name of the result to the column that is added up, or of which the extreme is taken. runs: name of
    the result to the column of which maximal runs of equal values in input order are counted (nulls are a value).
    """

    sums: dict[str, Column] = field(default_factory=dict)
    least: dict[str, Column] = field(default_factory=dict)
    most: dict[str, Column] = field(default_factory=dict)
    runs: dict[str, str] = field(default_factory=dict)


def per_key(df: DataFrame, key: str, measures: Measures | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns key_value, n_rows, n_chunks and the measures, one row for each key that isn't null.

    An empty table gives an empty table. Sums over nulls alone are null, as are extremes. Key types may be any that can be
    grouped. The number of chunk states is the number of keys plus rows / ``chunk_rows``.
    """
    m = measures or Measures()
    columns = {f"_m{i}": c for i, c in enumerate([*m.sums.values(), *m.least.values(), *m.most.values()])}
    source = df.select(F.col(key).alias("_k"), *[c.alias(name) for name, c in columns.items()], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(m.runs.values())])
    runs = [f"_r{i}" for i in range(len(m.runs))]
    rows = chunked(source, "_k", [*columns, *runs], chunk_rows)
    names = iter(columns)
    kinds = [(out, F.sum, next(names)) for out in m.sums] + [(out, F.min, next(names)) for out in m.least] + [(out, F.max, next(names)) for out in m.most]
    if runs:  # a change is seen by the later row; a chunk's first row leaves it to the merge
        inner = Window.partitionBy("_key", "_chunk").orderBy("_number")
        for r in runs:
            rows = rows.withColumn(f"{r}_new", (F.lag("_number").over(inner).isNotNull() & ~F.lag(r).over(inner).eqNullSafe(F.col(r))).cast("long"))
    states = rows.groupBy("_key", "_chunk").agg(
        F.count("*").alias("_rows"),
        *[how(c).alias(out) for out, how, c in kinds],
        *[x for r in runs for x in (F.sum(f"{r}_new").alias(f"{r}_new"), F.min_by(F.struct(r), "_number").alias(f"{r}_first"), F.max_by(F.struct(r), "_number").alias(f"{r}_last"))],
    )
    if runs:
        order = Window.partitionBy("_key").orderBy("_chunk")
        for r in runs:
            states = states.withColumn(f"{r}_new", F.col(f"{r}_new") + (~F.lag(f"{r}_last").over(order).eqNullSafe(F.col(f"{r}_first"))).cast("long"))
    return states.groupBy(F.col("_key").alias("key_value")).agg(
        F.sum("_rows").alias("n_rows"),
        F.count("*").alias("n_chunks"),
        *[how(out).alias(out) for out, how, _ in kinds],
        *[F.sum(f"_r{i}_new").alias(out) for i, out in enumerate(m.runs)],
    )


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns key_value (as text), n_rows: keys held by more than ``share`` of all rows, those without a key included."""
    total = df.agg(F.count("*").alias("_all"))
    keys = per_key(df.select(F.col(key)), key, chunk_rows=chunk_rows)
    return keys.join(F.broadcast(total), F.col("n_rows") > share * F.col("_all")).select(F.col("key_value").cast("string").alias("key_value"), "n_rows")
