"""Mixing sources to target shares of all tokens, small sources repeated at most a capped number of times.

Every document of a source has the same expected number of copies; its whole part is fixed and the fraction is rounded
by the pivotal method: two fractions are paired and mass, measured in tokens, moves from one to the other at random until
one of them is integral. The tokens of a source are thereby kept exactly, and every document keeps its expectation. Each
partition pairs its own documents and keeps at most one fraction a source; these residuals are paired in turn by a tree
of groups, until a single document of each source is left to be drawn.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tokens import count_tokens

#: Most sources a mix may have; their targets are a setting and live on the driver.
MOST_SOURCES = 10_000
#: Residual documents that one node of the tree pairs.
FAN_IN = 256
_CLOSE = 1e-9


def source_name(label: Column) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and hyphens as underscores. Null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), r"[\s-]+", "_")


class Pivot:
    """Running pivotal rounding of one source: holds at most one row whose fraction is still open."""

    def __init__(self, seed: list[int]):
        self.rng = np.random.default_rng(seed)
        self.open: tuple[int, float, float] | None = None

    def add(self, row: int, weight: float, share: float) -> Iterator[tuple[int, int]]:
        """Takes a row with its tokens and its fraction; gives (row, 0 or 1) of the rows that are decided by it."""
        if share <= _CLOSE or share >= 1 - _CLOSE:
            yield row, int(share > 0.5)
            return
        if self.open is None:
            self.open = row, weight, share
            return
        other, w, p = self.open
        self.open = None
        up, down = min((1 - p) * w, share * weight), min(p * w, (1 - share) * weight)
        move = up if self.rng.random() * (up + down) < down else -down
        for i, v, q in ((other, w, p + move / w), (row, weight, share - move / weight)):
            if q <= _CLOSE or q >= 1 - _CLOSE:
                yield i, int(q > 0.5)
            else:
                self.open = i, v, q


def plan_copies(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Expected copies of a document of each source.

    Without ``total`` the mix is as large as the caps allow: the source that is scarcest for its share is used up to its
    cap. Sources without tokens can't take part; the others keep their proportions.
    """
    live = [s for s in shares if shares[s] > 0 and tokens.get(s, 0) > 0 and repeats[s] > 0]
    if not live:
        return {}
    size = min(tokens[s] * repeats[s] / shares[s] for s in live)
    if total is not None:
        size = min(size, total / sum(shares[s] for s in live))
    return {s: min(float(repeats[s]), size * shares[s] / tokens[s]) for s in live}


def _settle(rows: pd.DataFrame, pivot: Pivot) -> pd.DataFrame:
    """Decides all rows of one source but at most one, which keeps a fraction; the fractions of the others become null."""
    pivot.open = None
    extra = np.zeros(len(rows), np.int64)
    for i, (weight, share) in enumerate(zip(rows["n_tokens"].tolist(), rows["fraction"].tolist(), strict=True)):
        for j, x in pivot.add(i, float(weight), share):
            extra[j] = x
    fraction = np.full(len(rows), np.nan)
    if pivot.open is not None:
        fraction[pivot.open[0]] = pivot.open[2]
    return rows.assign(copies=rows["copies"] + extra, fraction=fraction)


def _node(seed: int, rank: dict[str, int], depth: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A node of the tree: pairs the residuals of ``FAN_IN`` nodes below, in their order."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        node = int(rows["node"].iloc[0]) // FAN_IN
        rows = rows.sort_values(["n_tokens", "node"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pivot = Pivot([seed, rank[rows["source"].iloc[0]], depth, node])
        rows = _settle(rows, pivot).assign(node=node)
        if last and pivot.open is not None:  # nobody is left to pair with
            i, _, share = pivot.open
            rows.loc[i, "copies"] += int(pivot.rng.random() < share)
            rows.loc[i, "fraction"] = np.nan
        return rows

    return join


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 17, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``key``, source, n_tokens, copies, one row for each document that is used at least once; copies is at most the
    source's max_repeats. Report: source, target_share, max_repeats, n_docs, tokens_available, tokens_used, actual_share,
    one row for each target. Spellings of sources are made one first. Documents of no target, with a null source or
    key, and those without tokens are not used; a target without tokens is reported with 0. Without documents the mix is empty.
    A null share or cap counts as 0; of targets repeated under one name the shares add up and the larger cap holds.

    Texts are read once. Sizes go to the shared folder, then one pass decides all but a document a source and partition.
    """
    spark = docs.sparkSession
    listed = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    shares: dict[str, float] = {}
    repeats: dict[str, int] = {}
    for r in listed:
        shares[r["s"]] = shares.get(r["s"], 0.0) + float(r["target_share"] or 0)
        repeats[r["s"]] = max(repeats.get(r["s"], 0), int(r["max_repeats"] or 0))
    names = sorted(shares)
    named = docs.select(F.col(key), source_name(F.col(source)).alias("_source"), F.col(text).alias("_text"))
    counted = count_tokens(named.where(F.col(key).isNotNull() & F.col("_source").isin(names)), [key, "_source"], "_text", path=path)
    sizes = materialise(counted.select(F.col(key).alias("_key"), F.col("_source").alias("source"), "n_tokens"), "sizes")
    sums = {r["source"]: (r["n"], r["t"]) for r in sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    copies = plan_copies({s: t for s, (_, t) in sums.items()}, shares, repeats, total)
    rank = {s: i for i, s in enumerate(names)}

    kind = docs.schema[key].dataType.simpleString()
    columns = ["_key", "source", "n_tokens", "copies", "fraction", "node"]
    schema = f"_key {kind}, source string, n_tokens bigint, copies bigint, fraction double, node bigint"

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = TaskContext.get().partitionId()
        pivots: dict[str, Pivot] = {}
        held: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for name, rows in batch.groupby("source", sort=True):
                expected = copies.get(name, 0.0)
                base = math.floor(expected + _CLOSE)
                some = rows["n_tokens"] > 0
                rows = rows.assign(copies=np.where(some, base, 0), fraction=np.where(some, max(0.0, expected - base), 0.0), node=node)
                rows = rows.sort_values("n_tokens", ascending=False, kind="stable")  # large ones are paired with their like
                if name in held:
                    rows = pd.concat([held.pop(name), rows])
                rows = _settle(rows.reset_index(drop=True), pivots.setdefault(name, Pivot([seed, rank[name], 0, node])))
                left = rows["fraction"].notna()
                if left.any():
                    held[name] = rows[left]
                yield rows.loc[~left, columns]
        for rows in held.values():
            yield rows[columns]

    level = materialise(sizes.mapInPandas(leaf, schema), "leaf")
    nodes = max(1, sizes.rdd.getNumPartitions())
    decided, rest, depth = level.where("fraction is null"), level.where("fraction is not null"), 0
    while nodes > 1 or depth == 0:
        nodes, depth = math.ceil(nodes / FAN_IN), depth + 1
        done = materialise(rest.groupBy("source", F.floor(F.col("node") / FAN_IN)).applyInPandas(_node(seed, rank, depth, nodes == 1), schema), "level")
        decided, rest = decided.unionByName(done.where("fraction is null")), done.where("fraction is not null")
    mix = decided.where("copies > 0").select(F.col("_key").alias(key), "source", "n_tokens", F.col("copies").cast("int").alias("copies"))
    used = mix.groupBy("source").agg((F.sum(F.col("n_tokens") * F.col("copies"))).alias("tokens_used"))
    fixed = [(s, shares[s], repeats[s], *map(int, sums.get(s, (0, 0)))) for s in names]
    report = spark.createDataFrame(fixed, "source string, target_share double, max_repeats int, n_docs bigint, tokens_available bigint")
    report = report.join(used, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)).cast("bigint"))
    whole = used.agg(F.sum("tokens_used").alias("_all"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0))).drop("_all")
    return mix, report
