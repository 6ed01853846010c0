from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm.splitting import ASSEMBLY_GAP, boundaries, cut, split_oversized


def brute(seq, limit, overlap, least=10):
    ends, run = set(), 0
    for i, c in enumerate(seq + "A"):
        if c in "ACGTUacgtu":
            if run >= least:
                ends.add(i)
            run = 0
        else:
            run += 1
    if run >= least:
        ends.add(len(seq))
    pieces, s = [], 0
    while len(seq) - s > limit:
        fit = [g for g in ends if s + overlap < g <= s + limit]
        e = max(fit) if fit else s + limit
        pieces.append((s, e))
        s = e - overlap
    return [*pieces, (s, len(seq))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ANn-é"), st.integers(1, 30)), max_size=30), st.integers(20, 90), st.integers(0, 19))
def test_cut(runs, limit, overlap):
    seq = "".join(c * n for c, n in runs)
    got = cut(len(seq), boundaries(seq, re.compile(ASSEMBLY_GAP)), limit, overlap)
    if len(seq) > limit:
        assert got == brute(seq, limit, overlap)
    assert all(b - a <= limit for a, b in got)


def test_frames(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["ACGT" * 20, "N" * 12, "n" * 9, "-" * 10]) for _ in range(200))
    rows = [(1, long, 0), (1, long, 0), (2, None, 0), (3, "", 0), (4, "A" * 1000, 0), (5, "N" * 5001, 0), (6, "A" * 1001, 0), (7, "é" * 1500, 0)]
    df = spark.createDataFrame(rows, "n long, seq string, piece_no int")
    got: dict[int, list] = {}
    for r in split_oversized(df, pieces=True).collect():
        got.setdefault(r["n"], []).append((r["piece_no"], r["piece_start"], r["piece_end"]))
        source = next(x[1] for x in rows if x[0] == r["n"])
        assert r["piece"] == source[r["piece_start"] : r["piece_end"]]
    for n, seq in ((5, "N" * 5001), (6, "A" * 1001), (7, "é" * 1500)):
        assert got[n] == [(i, *p) for i, p in enumerate(brute(seq, 1000, 50), 1)]
    assert sorted(got[1]) == sorted([(i, *p) for i, p in enumerate(brute(long, 1000, 50), 1)] * 2)
    assert set(got) == {1, 5, 6, 7} and split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=10, overlap=10)
