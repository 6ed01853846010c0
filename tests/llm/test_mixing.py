from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import mixing, tokens

needs_files = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path()), reason="no vocabulary files here")


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(2)
    weights, shares = rng.integers(1, 50, 12).astype(float), rng.random(12)
    mean = np.zeros(12)
    for seed in range(3000):
        pivot, out = mixing.Pivot([seed]), {}
        for i in range(12):
            out.update(pivot.add(i, weights[i], shares[i]))
        kept = sum(weights[i] * x for i, x in out.items())
        rest = 0.0
        if pivot.open is not None:
            i, w, p = pivot.open
            rest = w * p
            out[i] = p
        assert kept + rest == pytest.approx((weights * shares).sum()) and len(out) == 12
        mean += [out[i] for i in range(12)]
    assert np.abs(mean / 3000 - shares).max() < 0.05


def test_plan():
    shares, repeats = {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}
    assert mixing.plan_copies({"a": 100, "b": 20}, shares, repeats) == {"a": 0.6, "b": 3.0}
    assert mixing.plan_copies({"a": 100, "b": 20}, shares, repeats, total=40) == {"a": 0.2, "b": 1.0}
    assert mixing.plan_copies({"a": 100}, shares, repeats) == {"a": 1.0} and mixing.plan_copies({}, shares, repeats) == {}


@needs_files
def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = [(i, " word" * (1 + i % 7), ["big ", "BIG", "small-one", "other", None][min(i % 9, 4)] if i % 9 < 4 else "big") for i in range(900)]
    rows += [(1000, None, "big"), (1001, "", "small_one"), (1002, "x", None), (None, "x", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7, "doc_id")
    targets = spark.createDataFrame([("Big", 0.6, 1), ("small_one", 0.4, 2), ("gone", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, targets)
    got = {r["doc_id"]: r for r in mix.collect()}
    assert all(r["copies"] <= (1 if r["source"] == "big" else 2) for r in got.values())
    assert {r["source"] for r in got.values()} == {"big", "small_one"} and not {1000, 1001, 1002, None} & set(got)
    lines = {r["source"]: r for r in report.collect()}
    assert set(lines) == {"big", "small_one", "gone"} and lines["gone"]["tokens_used"] == 0
    assert lines["big"]["actual_share"] == pytest.approx(0.6, abs=0.02) and lines["small_one"]["tokens_used"] == 2 * lines["small_one"]["tokens_available"]
    assert lines["big"]["tokens_used"] == sum(r["n_tokens"] * r["copies"] for r in got.values() if r["source"] == "big")
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, targets)[0].collect()}
    assert again == {k: r["copies"] for k, r in got.items()}
    empty = mixing.mix_sources(docs.limit(0), targets)
    assert empty[0].count() == 0 and [r["tokens_used"] for r in empty[1].collect()] == [0, 0, 0]
    assert mixing.mix_sources(docs, targets.limit(0))[0].count() == 0


def test_names(spark):
    df = spark.createDataFrame([(" North-Office ",), ("NORTH_OFFICE",), ("north office\t",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["north_office"] * 3 + [None]
