import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import op4_tokens as m

PATH = public_tokenizers.path(m.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_query_equals_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = m.op4_tokens(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 1024)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  x", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "I'll we've 12345 ½²", "日本語 тест 🙂🙂", "é  x‍", "aaaaaaaa" * 900, "\x00\x01\x7f", "  \t\r\n y"],
)
def test_texts(text, library):
    assert m._counter(PATH).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_edges(spark):
    schema = "doc_id long, text string, n_tokens string"
    assert m.token_counts(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(None, None, "x"), (1, "", "x"), (1, "a b", "x"), (1, "a b", "x"), (2, "word " * 2000, "x")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in m.token_counts(spark.createDataFrame(rows, schema), PATH).collect())
    assert got == [("1", 0, 0, False), ("1", 3, 2, False), ("1", 3, 2, False), ("2", 10000, 2001, True), ("None", 0, 0, False)]
