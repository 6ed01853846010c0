"""Connected components of a graph given by its edges: tasks contract what they hold, rounds of equi-joins do the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Edges that one task contracts.
EDGES = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in u followed by v) of every node but the roots, and of the smallest node of its component."""
    nodes, first, inverse = np.unique(np.concatenate((u, v)), return_index=True, return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return first[rest], first[root[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [b for b in batches if b.num_rows]
    if table:
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in table])
        node, root = forest(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in table]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([ends.take(pa.array(node)), ends.take(pa.array(root))], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "n_a", b: str = "n_b", rounds: int = 60) -> DataFrame:
    """Columns node, component of every node that an edge names; component is the smallest node that it reaches.

    Edges go to tasks of at most about ``EDGES`` of them, each of which contracts its own to a forest of stars. If that
    leaves more than one task's, two steps alternate until nothing changes: every node hands the smallest of its
    neighbourhood to its larger neighbours, then to its smaller ones. The number of rounds grows with the logarithm of the
    longest path, the edges never outnumber those given, and no step gathers a node's neighbours in one place: the minimum
    is pre-aggregated, and the join that hands it on is an equi-join whose hot keys Spark may split. Each round is written
    to the shared folder. Loops and null ends are left out; direction and repetition of edges don't matter.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    tasks = math.ceil(links.count() / EDGES)
    kind = links.schema["u"].dataType.simpleString()
    links = links.repartition(max(1, tasks)).mapInArrow(_contract, f"u {kind}, v {kind}")
    named = lambda links: links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
    if tasks <= 1:
        return named(materialise(links, "stars"))
    before = None
    for _ in range(rounds):
        links = materialise(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return named(links)


def _large_star(links: DataFrame) -> DataFrame:
    """Connects each node's larger neighbours to the smallest of its neighbourhood, itself included."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connects each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
