from __future__ import annotations

import random

import pytest

from helixmill.llm import components


def brute(edges):
    label: dict = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("size", [1_000_000, 40])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, monkeypatch, size, kind):
    monkeypatch.setattr(components, "EDGES", size)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 200), (200, 7), (7, 200)]
    edges += [(300, 300 + i) for i in range(40)]
    if kind == "string":
        edges = [(f"{a:03}", f"{b:03}") for a, b in edges]
    rng.shuffle(edges)
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, edges[0], (edges[0][0], edges[0][0]), (None, edges[0][0])], f"x {kind}, y {kind}")
    got = components.connected_components(df, "x", "y").collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == brute(edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "n_a long, n_b long")).count() == 0
