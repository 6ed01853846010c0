from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixmill.llm import langid, spans, tokens
from helixmill.llm.tokens import PerfectHash

FOLDER = "/root/testdata/sf0.1"
needs_files = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path(langid.PIECES)), reason="no vocabulary files here")
needs_data = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables here")


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"]
    scorer = langid.Scorer(pieces, ("x", "y"))
    rng = np.random.default_rng(1)
    p = rng.random((scorer.size, 2))
    for word in ("a", "ab", "abab", "bbaabaab", "aéb"):
        want = np.zeros(2)
        text = "▁" + word
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[last:i])
                    last = i
            parts.append(text[last:])
            value = np.ones(2)
            for part in parts:
                if part in pieces:
                    value = value * p[pieces.index(part)]
                elif len(part) == 1:
                    value = value * p[len(pieces) + part.encode()[0]]
                else:
                    value = value * 0
            want += value
        lattice = scorer.lattice([word])
        sums, _ = lattice.forward(p)
        assert sums[lattice.last][0] == pytest.approx(want)
        uses = lattice.expected(p, np.ones((1, 2)))
        lengths = np.array([len(t) for t in pieces] + [1] * 256)
        assert (uses * lengths[:, None]).sum(0) == pytest.approx(len(text))
    both = scorer.lattice(["ab", "bbaabaab"])
    alone = [scorer.lattice([w]).forward(p)[0][-1] for w in ("ab", "bbaabaab")]
    assert both.forward(p)[0][both.last] == pytest.approx(np.array(alone))


def test_decode_is_viterbi():
    rng = np.random.default_rng(2)
    row = np.sort(rng.integers(0, 6, 25))
    scores = rng.normal(0, 3, (25, 3))
    got = langid.decode(row, scores, 2.0)
    for r in set(row.tolist()):
        at = np.flatnonzero(row == r)
        value = lambda path: sum(scores[i, s] for i, s in zip(at, path, strict=True)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=min(len(at), 8)), key=value) if len(at) <= 8 else None
        if best is not None:
            assert value(tuple(got[at])) == pytest.approx(value(best))


def test_labels(spark):
    rows = ["en", " EN-gb ", "de_XX", "xx", "", None, "english", "zh", "-en"]
    df = spark.createDataFrame([(x,) for x in rows], "l string")
    assert [r[0] for r in df.select(langid.named_language(F.col("l"))).collect()] == ["en", "en", "de", None, None, None, None, "zh", None]


COMMON = {
    "en": "the is of and that by",
    "de": "der die das und wird ist dass",
    "fr": "le les est du et une que",
    "es": "el los se una y en",
    "nl": "het een wordt van de en dat",
    "pt": "o os um uma do não e",
    "ru": "и в не что на он",
}


def plainly(sentence):
    """Language by common words alone, to leave out sentences with a wrong label."""
    words = sentence.lower().split()
    return max(COMMON, key=lambda c: sum(w in COMMON[c].split() for w in words))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), per_language=60)


@needs_files
@needs_data
def test_held_out_accuracy(spark, model):
    """Documents outside the sample, against their stored labels (of which some are wrong)."""
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.document_languages(df, model)
    both = df.select("doc_id", langid.named_language(F.col("lang")).alias("c")).join(found, "doc_id").where("c is not null and lang is not null")
    right, every = both.agg(F.sum((F.col("c") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right > 0.85 * every
    assert found.count() == df.count() and found.where("lang is null and confidence > 0").count() == 0


@needs_files
@needs_data
def test_composed_texts(spark, model):
    """Segments of texts that are put together from sentences of known languages."""
    rng = random.Random(7)
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sure = df.select("text", langid.named_language(F.col("lang")).alias("c")).where("c is not null and length(text) > 800").limit(1500).collect()
    sentences: dict[str, list[str]] = {}
    for r in sure:
        for s in r["text"].split(". ")[2:4]:
            if len(s) > 90 and "\n" not in s and plainly(s) == r["c"]:
                sentences.setdefault(r["c"], []).append(s + ". ")
    scorer = langid.Scorer(model.pieces, model.languages)
    scorer.use(model.p.astype(float))
    texts, truth = [], []
    codes = sorted(c for c in sentences if len(sentences[c]) > 5 and c != "zh")
    for _ in range(300):
        a, b = rng.sample(codes, 2)
        texts.append("".join(rng.choices(sentences[a], k=4) + [rng.choice(sentences[b])] + rng.choices(sentences[a], k=2)))
        truth.append({a, b})
    found = langid.segments(scorer.units(pa.array(texts)))
    good = 0
    for i, want in enumerate(truth):
        at = (found["row"] == i) & (found["end"] - found["start"] >= 60) & (found["lang"] >= 0)
        good += {model.languages[x] for x in found["lang"][at]} == want
    assert good > 0.95 * len(texts)


@needs_files
@needs_data
def test_odd_texts(spark, model, monkeypatch):
    text = "The circuit is arranged so that the membrane opens before the controller has reached its end position. "
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, " \n", None, 1), (4, "R₁–(CH₂)19–COOH → $\\frac{5{k_B T}$$ = \\sum_{i=0}^{ 12 34", "de", 1), (5, text, "de-DE", 1), (5, text, "de-DE", 1), (6, text, "en_GB", 1), (None, text, None, 1), (7, "x" * 5000, "en", 1), (8, text * 200, "??", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence int")
    assert {tuple(r) for r in langid.unnamed_languages(df, model).collect()} == {(5, "en"), (None, "en"), (8, "en")}
    docs = langid.document_languages(df, model).collect()
    assert len(docs) == len(rows) and all(r["lang"] is None and r["confidence"] == 0 for r in docs if r["doc_id"] in (1, 2, 3))
    parts = langid.language_segments(df, model).collect()
    assert all(r["seg_start"] < r["seg_end"] for r in parts) and {r["doc_id"] for r in parts} >= {5, 6, 8, None}
    assert langid.unnamed_languages(df.limit(0), model).count() == 0
    none = langid.fit(df.limit(0))
    assert langid.document_languages(df, none).where("lang is not null").count() == 0
    scorer = langid.Scorer(model.pieces, model.languages)
    scorer.use(model.p.astype(float))
    texts = pa.array([text * 30, "a", text * 3])
    whole = langid.segments(scorer.units(texts))
    monkeypatch.setattr(spans, "BLOCK_BYTES", 300)
    parts = langid.segments(scorer.units(texts))
    assert all((whole[k] == parts[k]).all() for k in ("row", "start", "end", "lang"))


def test_empty_perfect_hash():
    assert PerfectHash(np.zeros(0, np.uint64), np.zeros(0, np.int32)).get(np.array([1], np.uint64)).tolist() == [-1]
