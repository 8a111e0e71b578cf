import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.llm.bpe import DEFAULT_VOCABULARY, PATTERN, Vocabulary, encode_table

tiktoken = pytest.importorskip("tiktoken")
DATA, VOCABULARY = Vocabulary.read(DEFAULT_VOCABULARY)
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_public_library_and_decodes(text):
    ids = VOCABULARY.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, " " * 5000, "\r\n\t x\u00a0y", "<|endoftext|>", "e\u0301\u200b\U0001f469\u200d\U0001f4bb", "漢字かな" * 500])
def test_long_and_odd_texts(text):
    assert VOCABULARY.encode(text) == PUBLIC.encode_ordinary(text)


def test_null_empty_and_surrogates():
    assert VOCABULARY.encode(None) == [] and VOCABULARY.encode("") == []
    assert VOCABULARY.decode(VOCABULARY.encode("a\ud800b")) in ("a?b", "a\ufffdb")


def test_table(spark):
    rows = spark.createDataFrame([(1, "one two", "x", 9), (2, None, "x", 9), (3, "", None, 9), (1, "one two", "x", 9)], "doc_id long, text string, source string, n_tokens int")
    got = sorted(map(tuple, encode_table(rows, keep=("source",)).collect()))
    one = PUBLIC.encode_ordinary("one two")
    assert [(r[0], r[2], r[3]) for r in got] == [(1, one, 2), (1, one, 2), (2, [], 0), (3, [], 0)]
    assert encode_table(rows.limit(0)).count() == 0


def test_tables_decode_to_their_texts(spark):
    from sedimark.llm.bpe import decode_table, encode_table

    texts = ["plain words", "", None, "é🙂\r\n\tx  y", "a" * 500, "x\x00y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in decode_table(encode_table(rows), keep=("doc_id",)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
