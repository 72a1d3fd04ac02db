import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarazu.llm import tokens
from tarazu.llm.tokens import DEFAULT_VOCABULARY

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not Path(DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def exact():
    path = DEFAULT_VOCABULARY.replace(".json", ".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = ["", " ", "\n\n  x", "a" * 500, " " * 300, "aaaaaaaab" * 40, "<|endoftext|> and <|im_start|>", "it's we'll 'll", "\r\n\r\n", "‌﻿�", "👍🏽🙂", "۱۲۳ 123", "قلعہ کے لوگ", "हिन्दी में", "ﷺ", "\x00\x01", "é é", "=" * 777, "ab" * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_hard_texts(exact, text):
    assert tokens.encoder(DEFAULT_VOCABULARY).encode(text) == exact(text)
    assert tokens.counter(DEFAULT_VOCABULARY).count(text) == len(exact(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab lo'st\nكی ہے .0۱")), max_size=60))
def test_any_text(exact, text):
    assert tokens.encoder(DEFAULT_VOCABULARY).encode(text) == exact(text)
    assert tokens.counter(DEFAULT_VOCABULARY).count(text) == len(exact(text))


def test_whole_tables(spark, train, documents, exact):
    ids = {r.doc_id: r.ids for r in tokens.token_ids(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert ids == {k: exact(t) if t else [] for k, t in texts.items()}
    totals = tokens.token_totals(train, documents).collect()
    wanted = sum(len(exact(r.text)) for t in (train, documents) for r in t.select("text").collect() if r.text)
    assert sum(r.n_tokens for r in totals) == wanted
    assert sum(r.n_records for r in totals) == train.count() + documents.count()
    nulls = {(r.table_name, r.source, r.lang, r.category) for r in totals if None in tuple(r)}
    assert nulls


def test_round_trip(documents):
    v = tokens.vocabulary(DEFAULT_VOCABULARY)
    e = tokens.encoder(DEFAULT_VOCABULARY)
    for r in documents.select("text").collect():
        if r.text:
            assert "".join(v.text[i] for i in e.encode(r.text)).encode("latin-1").decode() == r.text


def test_nulls_empty_and_no_rows(spark, make_documents, make_train):
    d = make_documents(None, "", "x")
    assert [r.ids for r in tokens.token_ids(d).orderBy("doc_id").collect()][:2] == [[], []]
    assert [r.n_text_tokens for r in tokens.token_counts(d, "doc_id").orderBy("doc_id").collect()] == [None, 0, 1]
    assert tokens.token_ids(d.limit(0)).count() == 0
    assert tokens.token_totals(make_train(), d.limit(0)).count() == 0


def test_clashing_columns(spark, make_documents):
    d = make_documents("x y").withColumnRenamed("domain", "tokens")
    with pytest.raises(ValueError):
        tokens.with_token_counts(d)
    assert tokens.with_token_counts(d, out="n").first().n == 2
