from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm import spans, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path()), reason="no vocabulary files here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def encoder(ranks):
    return tokens.Encoder(ranks)


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_entry_is_its_own_encoding(ranks):
    """Tier one may give a vocabulary entry's id for a whole pre-token only if merging gives the same."""
    for word, i in ranks.items():
        assert tokens.merge_bytes(word, ranks) == [i]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        table = tokens.PerfectHash(keys, np.arange(len(keys), dtype=np.int32))
        assert (table.get(keys) == np.arange(len(keys))).all() and (table.get(keys + np.uint64(1)) == -1).sum() >= len(keys) - 1
        assert len(table.keys) == len(keys)


ODD = ["don't", "'tis", "it's  'S", "  a", "a  b\n\n c", " \n", "'", "''s", "'re'r've", "x'll\t1²½ ", "　a", "a's", "<|endoftext|>", "ab̀c\U0001f600‍中文 字", "\r\n \r\n"]
text = st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevmld  \n\t　.1aé²中"), st.characters(codec="utf-8"))), max_size=5)


@settings(max_examples=400, deadline=None)
@given(text)
def test_same_as_reference(encoder, reference, texts):
    texts = [t for t in texts if all(unicodedata.category(c) != "Cn" for c in t)]
    want = [reference.encode_ordinary(t) for t in texts]
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == want
    assert encoder.count(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def test_odd_texts(encoder, reference):
    assert encoder.encode(pa.array(ODD)).to_pylist() == [reference.encode_ordinary(t) for t in ODD]
    assert encoder.encode(pa.array([None, "", " "])).to_pylist() == [[], [], [220]]
    assert encoder.encode(pa.array([], pa.string())).to_pylist() == []


def test_long_texts_come_in_parts(ranks, reference, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_BYTES", 40)
    small = tokens.Encoder(ranks, cache_bits=2)
    texts = ["word  spaced\n\nout " * 40, "a", "x" * 500, None, " " * 300, "é ü" * 100]
    assert small.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t or "") for t in texts]
    assert small.encode(pa.array(texts).slice(1, 4)).to_pylist() == [reference.encode_ordinary(t or "") for t in texts[1:5]]


def test_cache_starts_over(ranks, reference, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_IDS", 20)
    small = tokens.Encoder(ranks, cache_bits=3)
    for _ in range(3):
        texts = [f"qzxv{i}wkjh jjqq{i}" for i in range(30)]
        assert small.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_frames(spark, reference):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (None, " ", 9), (1, "Hello world", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((k or 0, reference.encode_ordinary(t or "")) for k, t, _ in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"]).collect()) == [0, 0, 1, 2, 2]
