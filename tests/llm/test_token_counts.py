import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from geomarket.llm.token_counts import PrefixCounter, count_documents, fitting_prefix

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tokens():
    return PrefixCounter(MODEL)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(" ab the\n\t▁é梦Ω𝄞ñ.,<s>"), max_size=25))
def test_counts_are_the_models(model, tokens, text):
    assert tokens.count([text]) == [len(model.encode(text))]
    assert tokens.table(text).tolist() == [len(model.encode(text[:k])) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["a" * 500, " " * 77, "x" + " " * 40 + "y", "</s><unk>", "the" * 300, "\n" * 50])
def test_long_words_and_runs(model, tokens, text):
    assert tokens.count([text]) == [len(model.encode(text))]


def test_real_texts(small_docs, model):
    expected = {r.doc_id: (len(r.text.encode()), len(model.encode(r.text))) for r in small_docs.collect()}
    found = count_documents(small_docs, MODEL, limit=300).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == expected
    assert all(r.over_limit == (r.n_tokens > 300) for r in found)


def test_fitting_prefix(spark, model):
    rows = fitting_prefix(spark.createDataFrame([("the house of the rising sun",), ("",), (None,)], "text string"),
                          MODEL, budget=4).collect()
    text, n = rows[0].text, rows[0].fitting_chars
    assert len(model.encode(text[:n])) <= 4
    assert all(len(model.encode(text[:k])) > 4 for k in range(n + 1, len(text) + 1))
    assert [r.fitting_chars for r in rows[1:]] == [0, 0]


def test_odd_rows(odd_docs, no_docs, model):
    expected = sorted((str(r.doc_id), len(model.encode(r.text or ""))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in count_documents(odd_docs, MODEL).collect()) == expected
    assert count_documents(no_docs, MODEL).count() == 0
