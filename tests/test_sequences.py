"""Sequence operators against golden values, hand-derived cases and plain-Python versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill import api, kernels
from helixmill.functions import codec
from helixmill.operators import cgr, counter, coverage, kmers, minimisers, oligo

READS = [
    "GGGTGATGGCCGCTGCCGATGGCGTCAAATCCCACCAAGTTACCCTTAACAACTTAAGGGTTTTCAAATAGA",
    "GTTCAGGGATACGACGTTTGTATTTTAAGAATCTGAAGCAGAAGTCGATGATAATACGCGTCGTTTTATCAT",
]
COMPLEMENT = str.maketrans("ACGT", "TGCA")
dna = st.text(alphabet="ACGTacgtuUNR\x00é", max_size=60)


def plain(seq):
    table = {**dict.fromkeys("Aa\x00", "A"), **dict.fromkeys("Cc\x01", "C"), **dict.fromkeys("Gg\x02", "G"), **dict.fromkeys("TtUu\x03", "T")}
    return "".join(table.get(c, "N") for c in seq)


def revcomp(kmer):
    return kmer.translate(COMPLEMENT)[::-1]


def code(kmer):
    out = 0
    for c in kmer:
        out = out * 4 + "ACGT".index(c)
    return out


def windows(seq, k):
    seq = plain(seq)
    return [(i, seq[i : i + k]) for i in range(len(seq) - k + 1) if "N" not in seq[i : i + k]]


def brute_spans(seq, w, m):
    seq, out, before = plain(seq), [], None
    for s in range(len(seq) - w + 1):
        part = seq[s : s + w]
        if "N" in part or w < m:
            before = None
            continue
        best = min(min(part[i : i + m], revcomp(part[i : i + m])) for i in range(w - m + 1))
        if before == best:
            out[-1] = (best, out[-1][1], s + w)
        else:
            out.append((best, s, s + w))
        before = best
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(dna, max_size=5), st.integers(1, 31))
def test_kmer_kernel(seqs, k):
    got = []
    for c, bounds, rows, begins, _ in kernels.stretches(pa.array(seqs, pa.string()), k):
        at, forward, reverse = kernels.kmers(c, bounds, k)
        owner = np.searchsorted(bounds, at, "right") - 1
        got += list(zip(rows[owner].tolist(), (at - bounds[owner] + begins[owner]).tolist(), forward.tolist(), reverse.tolist(), strict=True))
    assert got == [(i, p, code(f), code(revcomp(f))) for i, s in enumerate(seqs) for p, f in windows(s, k)]


@settings(max_examples=150, deadline=None)
@given(st.lists(dna, max_size=4), st.integers(1, 9), st.integers(0, 9))
def test_spans_kernel(seqs, m, more):
    s = minimisers.spans(pa.array(seqs, pa.string()), m + more, m)
    got = list(zip(s.row.tolist(), kernels.text_of(s.value, m).to_pylist(), s.start.tolist(), s.end.tolist(), strict=True))
    assert got == [(i, *x) for i, seq in enumerate(seqs) for x in brute_spans(seq, m + more, m)]


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT" * 20 + "N") for _ in range(n)) for n in (400, 3, 90, 1000)]
    texts = pa.array(seqs)
    whole = minimisers.spans(texts, 20, 7), oligo.composition(texts, 3), kernels.canonical_sets(texts, 11)
    monkeypatch.setattr(kernels, "BLOCK", 64)
    parts = minimisers.spans(texts, 20, 7), oligo.composition(texts, 3), kernels.canonical_sets(texts, 11)
    for a, b in zip((*vars(whole[0]).values(), whole[1], *whole[2]), (*vars(parts[0]).values(), parts[1], *parts[2]), strict=True):
        assert (a == b).all()


def test_codec(spark):
    assert api.to_numeric("ACGTT") == (111, 27)
    assert api.to_acgt(111, 5) == "ACGTT" and api.to_acgt(27, 5) == "AACGT"
    with pytest.raises(ValueError):
        api.to_numeric("ACN")
    rows = [("ACGTT",), ("acgtu",), ("ACN",), ("",), (None,), ("T" * 31,), ("T" * 32,)]
    df = spark.createDataFrame(rows, "s string").select("s", codec.encode(F.col("s")).alias("c"), codec.encode_pair(F.col("s")).alias("p"))
    assert [r["c"] for r in df.collect()] == [111, 111, None, None, None, 4**31 - 1, None]
    assert tuple(df.first()["p"]) == (111, 27)
    back = spark.range(0, 4**5).select("id", codec.decode(F.col("id"), 5).alias("t"), codec.reverse_complement_code(F.col("id"), 5).alias("r"))
    assert all(code(r["t"]) == r["id"] and r["r"] == code(revcomp(r["t"])) for r in back.collect())
    codec.register(spark)
    assert spark.sql("select kmer_canonical('TTTAC'), kmer_encode('ACGTT'), kmer_decode(27L, 5), size(kmer_windows('AC', 3))").first()[:] == ("GTAAA", 111, "AACGT", 0)
    lateral = spark.sql("SELECT s, pos, kmer FROM VALUES ('ACNguu'), ('A'), (null) v(s), LATERAL kmer_table(s, 2)").collect()
    assert sorted(tuple(r) for r in lateral) == [("ACNguu", 0, "AC"), ("ACNguu", 3, "AC"), ("ACNguu", 4, "AA")]
    with pytest.raises(ValueError):
        kmers.position_codes(13)


def test_kmer_table_moves_nothing(spark):
    """Windows come from the row itself, however long it is; no sequence travels with its windows."""
    codec.register(spark)
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGTacguN", [9] * 8 + [1], k=size)) for size in (*range(9), 31, 36, 37, 38, 69, 70, 1000)]
    texts += [texts[-1], "ACGTAé\nACGTACGT", "NNNNNNNNN", "", None]
    spark.createDataFrame(list(enumerate(texts)), "n long, seq string").createOrReplaceTempView("kmer_table_rows")
    for k in (1, 6, 31):
        got = spark.sql(f"SELECT n, pos, kmer FROM kmer_table_rows, LATERAL kmer_table(seq, {k})")
        want = [(n, i, min(f, revcomp(f))) for n, text in enumerate(texts) for i, f in windows(text or "", k)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert spark.sql("SELECT n, pos, kmer FROM kmer_table_rows, LATERAL kmer_table(seq, 0)").count() == 0


def test_pairs(spark):
    assert list(api.KmerGenerator("ACGT", 2)) == [(1, 11), (6, 6), (11, 1)]
    assert list(api.KmerGenerator("ACNGTT", 2)) == [(1, 11), (11, 1), (15, 0)]
    df = spark.createDataFrame([(1, "ACNGTT"), (2, None), (3, ""), (4, "A")], "n long, seq string")
    assert [tuple(r) for r in kmers.kmer_pairs(df, 2).collect()] == [(1, 0, 1, 11), (1, 3, 11, 1), (1, 4, 15, 0)]
    assert [tuple(r) for r in kmers.kmer_windows(df, 2).collect()] == [(1, 0, "AC"), (1, 3, "AC"), (1, 4, "AA")]


def test_positions(spark):
    for k, size in ((3, 32), (4, 136), (5, 512), (6, 2080), (7, 8192)):
        assert len(kmers.header(k)) == size
    names = api.OligoComputer(4).get_header()
    assert (names[0], names[-1], len(api.OligoComputer(4).get_header(False))) == ("AAAA", "TTAA", 256)
    place, codes, count = api.KmerGenerator("", 4).kmer_pos_maps()
    assert count == 136 and codes[0] == 0 and all(place[c] == i for i, c in codes.items())
    rows = kmers.vector_positions(spark, 4).orderBy("pos").collect()
    assert [r["kmer"] for r in rows] == names


def test_oligo(spark):
    one = api.OligoComputer(4).vectorise_one("AAAANGAGA")
    assert (one[0], sum(one)) == (0.5, 1.0)
    assert api.OligoComputer(4).vectorise_one("AAAANGAGA", False)[0] == 1.0
    assert sum(api.OligoComputer(4).vectorise_one(READS[0], True, False)) == pytest.approx(0.5)
    df = spark.createDataFrame([(0, READS[0]), (1, ""), (2, None), (3, "NNNN")], "n long, seq string")
    got = {r["n"]: r["kvec"] for r in oligo.oligo_vectors(df, 3, canonical_only=False).collect()}
    assert len(got[0]) == 64 and sum(got[0]) == pytest.approx(1) and got[1] == got[2] == got[3] == [0.0] * 64
    raw = oligo.composition(pa.array([READS[1]]), 4)[0]
    back = oligo.composition(pa.array([revcomp(READS[1])]), 4)[0]
    assert raw.tolist() == back.tolist() and raw.sum() == 69
    assert oligo.long_form(oligo.oligo_vectors(df.where("n = 0"), 3), 3).where("value > 0").count() > 0


def test_counts_and_coverage(spark):
    df = spark.createDataFrame(list(enumerate(READS)), "n long, seq string")
    counts = counter.kmer_counts(df, 15, acgt=True).collect()
    assert len(counts) == 116 and sum(r["count"] for r in counts) == 116
    bins = coverage.coverage_histograms(df, 4, 2, 3, norm=False).orderBy("n").collect()
    assert [r["bin_count"] for r in bins] == [[22, 44, 3], [13, 55, 1]]
    shares = coverage.coverage_histograms(df, 4, 2, 3).collect()
    assert all(sum(r["bin_count"]) == pytest.approx(1) for r in shares)
    dirty = spark.createDataFrame([(1, None), (2, ""), (3, "ACG"), (None, "ACGTACGT"), (4, "ACGTACGTACGTACGT"), (4, "ACGT")], "n long, seq string")
    got = {r["n"]: r["bin_count"] for r in coverage.coverage_histograms(dirty, 4, 5, 2, norm=False).collect()}
    assert got == {1: [0, 0], 2: [0, 0], 3: [0, 0], 4: [3, 11]}
    alt = spark.createDataFrame([(9, READS[0])], "n long, seq string")
    assert coverage.coverage_histograms(df, 15, 1, 2, norm=False, alt=alt).orderBy("n").collect()[1]["bin_count"] == [58, 0]
    empty = df.limit(0)
    assert coverage.coverage_histograms(empty, 4).count() == counter.kmer_counts(empty, 4).count() == 0


def test_merge(spark):
    parts = [(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 1, 3), (0, 1, 2, 4), (0, 1, 2, 4), (0, 2, 6, None), (1, 0, 11, 10), (1, 0, 22, 20), (1, 1, 11, 12), (1, 1, 23, 24)]
    df = spark.createDataFrame(parts, "part_no int, chunk_no int, kmer long, cnt int")
    assert {tuple(r) for r in counter.merge_counts(df, 15).collect()} == {(1, 4), (2, 6), (6, 0), (11, 22), (22, 20), (23, 24)}
    assert "A" * 14 + "C" in {r["kmer"] for r in counter.merge_counts(df, 15, acgt=True).collect()}




def test_minimisers(spark):
    df = spark.createDataFrame(list(enumerate(READS)), "n long, seq string")
    whole = minimisers.minimiser_spans(df, 0, 10).orderBy("n").collect()
    assert [tuple(r) for r in whole] == [(0, "AAAACCCTTA", 0, 72), (1, "AAAACGACGC", 0, 72)]
    built_in = {tuple(r) for r in minimisers.minimiser_spans_sql(df, 31, 7).collect()}
    assert built_in == {tuple(r) for r in minimisers.minimiser_spans(df, 31, 7).collect()} != set()
    lists = minimisers.sequences_to_minimisers(df.union(spark.createDataFrame([(7, None)], df.schema)), 31, 7).collect()
    assert {(r["n"], *s) for r in lists for s in r["spans"]} == built_in and len(lists) == 3
    bins = minimisers.minimisers_to_sequences(df, 31, 7).collect()
    assert {(m["n"], r["minimiser"], m["span_start"], m["span_end"]) for r in bins for m in r["members"]} == built_in
    parts = minimisers.minimisers_to_sequences(df.union(df), 31, 7, chunk=1).collect()
    assert all(len(r["members"]) == 1 for r in parts) and len(parts) == 2 * len(built_in)
    for bad in ((3, 7), (40, 32), (-1, 7)):
        with pytest.raises(ValueError):
            minimisers.check(*bad)


def test_compat_minimisers():
    spans = lambda seq, w, m: [(api.to_acgt(v, m), a, b) for v, a, b in api.MinimiserGenerator(seq, w, m)]
    # a new minimiser in the last window alone is not reported; the same one as the only window is
    seq = "CCGGTAAA"
    assert brute_spans(seq, 4, 3)[-1][1:] == (4, 8)
    assert spans(seq, 4, 3) == brute_spans(seq, 4, 3)[:-1]
    assert spans("GTAA", 4, 3) == brute_spans("GTAA", 4, 3)
    # the unambiguous end has at least m but fewer than w bases
    assert spans("CCGGTANAAAC", 6, 3) == [*brute_spans("CCGGTANAAAC", 6, 3), ("TTT", 7, 11)]
    assert spans("NAAAC", 0, 3) == [("TTT", 1, 5)] and spans("AC", 0, 3) == []
    assert spans("AAACN", 0, 3) == []


@settings(max_examples=100, deadline=None)
@given(dna)
def test_kmer_minimisers_agree(seq):
    rows = list(api.KmerMinimiserGenerator(seq, 8, 5))
    assert [(api.to_acgt(v, 5), a, b) for v, a, b, _ in rows] == brute_spans(seq, 8, 5)
    assert [x for r in rows for x in r[3]] == [code(min(f, revcomp(f))) for _, f in windows(seq, 8)]


def test_kmer_minimisers(spark, monkeypatch):
    seq = "".join(random.Random(4).choice("ACGT" * 9 + "N") for _ in range(300))
    df = spark.createDataFrame([(1, seq), (2, None)], "n long, seq string")
    got = sorted(tuple(r) for r in kmers_of(df))
    want, before = [], None
    for p, f in windows(seq, 8):
        best = min(min(f[i : i + 5], revcomp(f[i : i + 5])) for i in range(4))
        listed = before[1] if before and before[0] == p - 1 else best
        want.append((1, p, min(f, revcomp(f)), listed))
        before = (p, best)
    assert got == want


def kmers_of(df):
    return minimisers.kmer_minimisers(df, 8, 5).collect()


def test_cgr(spark):
    point, want = (0.5, 0.5), []
    corners = {"A": (0, 0), "C": (0, 1), "G": (1, 1), "T": (1, 0), "U": (1, 0)}
    for c in READS[0]:
        point = tuple((a + b) / 2 for a, b in zip(corners[c], point, strict=True))
        want.append(point)
    assert api.CgrComputer(1).vectorise_one(READS[0].lower()) == want
    with pytest.raises(ValueError):
        api.CgrComputer(1).vectorise_one("ACGN")
    df = spark.createDataFrame([(0, READS[0][:20]), (1, "ACN"), (2, None), (3, "")], "n long, seq string")
    rows = {r["n"]: r for r in cgr.cgr_paths(df, mode="PERMISSIVE").collect()}
    assert [tuple(p) for p in rows[0]["path"]] == want[:20]
    assert rows[1]["path"] is None and "N" in rows[1]["error"] and rows[2]["path"] == rows[3]["path"] == []
    with pytest.raises(Exception, match="bad base"):
        cgr.cgr_paths(df).collect()
    fold = df.where("n = 0").select(cgr.cgr_path_sql(F.col("seq")).alias("p")).first()["p"]
    assert [tuple(p) for p in fold] == want[:20]


def test_cgr_lanes(monkeypatch):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1000, 0, 5, 300)] + ["A" * 400, "T" * 400]
    whole = api.CgrComputer(3).vectorise_batch(seqs)
    for ahead in (128, 8, 1):
        monkeypatch.setattr(cgr, "LANE", 50)
        monkeypatch.setattr(cgr, "AHEAD", min(ahead, 50))
        assert api.CgrComputer(3).vectorise_batch(seqs) == whole


def test_kmer_cgr(spark):
    df = spark.createDataFrame([(0, READS[0]), (1, None)], "n long, seq string")
    rows = {r["n"]: r["points"] for r in cgr.kmer_cgr(df, 4, 16, norm=False).collect()}
    assert len(rows[0]) == 136 and sum(p["freq"] for p in rows[0]) == 69 and sum(p["freq"] for p in rows[1]) == 0
    assert (rows[0][0]["x"], rows[0][0]["y"]) == (0.5, 0.5)
    assert [cgr.kmer_size(k) for k in (3, 4, 5, 6, 7)] == [9, 16, 25, 36, 49]
    assert cgr.kmer_point_table(spark, 4, 16).count() == 136


def test_stats(spark):
    df = spark.createDataFrame([(0, READS[0]), (1, READS[1]), (2, None)], "n long, seq string")
    assert kmers.sequence_stats(df).first()[:] == (3, 144)
    assert kmers.sequence_stats(df.limit(0)).first()[:] == (0, 0)
