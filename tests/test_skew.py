from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators.skew import Measures, chunked, heavy_keys, per_key

RNG = random.Random(3)
ROWS = [(RNG.choice([7] * 12 + [1, 2, None, 3]), RNG.choice([0, 0, 0, 1, None]), i) for i in range(500)]


def frame(spark, rows=None, parts=5):
    return spark.createDataFrame(spark.sparkContext.parallelize(ROWS if rows is None else rows, parts), "k int, v int, i int")


def test_chunks(spark):
    rows = chunked(frame(spark), "k", ["i"], 37).collect()
    assert len(rows) == sum(r[0] is not None for r in ROWS)
    for key in (1, 2, 3, 7):
        mine = sorted((r for r in rows if r["_key"] == key), key=lambda r: r["_number"])
        assert [r["_number"] for r in mine] == list(range(len(mine)))
        assert [r["i"] for r in mine] == [i for k, _, i in ROWS if k == key]
        assert all(r["_chunk"] == r["_number"] // 37 for r in mine)


def test_per_key(spark):
    what = Measures(sums={"total": F.col("v")}, least={"first": F.col("i")}, most={"last": F.col("i")}, runs={"runs": "v"})
    for size in (1, 10, 1000):
        got = {r["key_value"]: r for r in per_key(frame(spark), "k", what, size).collect()}
        assert set(got) == {1, 2, 3, 7}
        for key, r in got.items():
            mine = [x for x in ROWS if x[0] == key]
            known = [v for _, v, _ in mine if v is not None]
            assert (r["n_rows"], r["n_chunks"]) == (len(mine), -(-len(mine) // size))
            assert (r["total"], r["first"], r["last"]) == (sum(known), mine[0][2], mine[-1][2])
            assert r["runs"] == len(list(itertools.groupby(v for _, v, _ in mine)))


def test_heavy(spark):
    rows = [(1, None, 0)] * 3 + [(2, None, 0)] * 2 + [(None, None, 0)] * 95
    assert [tuple(r) for r in heavy_keys(frame(spark, rows), "k").collect()] == [("1", 3)]
    assert heavy_keys(frame(spark, [(None, 1, 1)]), "k").count() == 0
    empty = frame(spark).limit(0)
    assert heavy_keys(empty, "k").count() == per_key(empty, "k").count() == 0


def test_clashing_names(spark):
    df = frame(spark).select("k", F.lit(1).alias("_key"), F.lit(2).alias("_part"), F.lit(3).alias("n_rows"))
    assert {r["key_value"] for r in per_key(df, "k").collect()} == {1, 2, 3, 7}


@pytest.mark.parametrize("size", ["1KB", "64MB"])
def test_behind_an_exchange(spark, size):
    """No row is lost where AQE cuts the partitions of an exchange anew: repartitioned, joined and aggregated input."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        base = spark.range(6000).select((F.col("id") % 2000).alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("int").alias("k"), F.repeat(F.lit("x"), 50).alias("wide"), F.col("id").alias("v"))
        other = spark.range(2000).select(F.col("id").alias("g"), (F.col("id") * 2).alias("w"))
        for df in (base.repartition("g"), base.join(other.hint("shuffle_hash"), "g"), base.groupBy("g", "k").agg(F.max("v").alias("v"))):
            got = {r["key_value"]: r for r in per_key(df, "k", Measures(sums={"total": F.col("v")}), 50).collect()}
            want = {r["k"]: r for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("t")).collect()}
            assert {k: (r["n_rows"], r["total"]) for k, r in got.items()} == {k: (r["n"], r["t"]) for k, r in want.items()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
