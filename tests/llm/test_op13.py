import hashlib
import struct

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op13_byte_bpe as m

PATH, PATTERN = public_tokenizers.path(m.VOCABULARY), public_tokenizers.PATTERN


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Byte-pair merging as it is defined: the adjacent pair of lowest rank, leftmost first, until none is left."""
    tokens = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[t] for t in tokens]
        _, i = min(pairs)
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def plain(text: str) -> list[int]:
    ranks = m.encoding(PATH, PATTERN)._mergeable_ranks
    return [x for piece in regex.findall(PATTERN, text) for x in merged(ranks, piece.encode())]


def test_query_equals_definition_and_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library = m.encoding(PATH, PATTERN)
    rows = m.op13_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        if len(docs[r.doc_id]) < 3000:
            assert ids == plain(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


ALPHABET = st.sampled_from("ab'sléß9½٣ \t\n \x1c .!#日本🙂́")


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.integers(1, 9))
def test_cutting_changes_no_id(text, long):
    assert "".join(m.parts(text, long)) == text
    assert m.encoded(m.encoding(PATH, PATTERN), text, long) == m.encoding(PATH, PATTERN).encode_ordinary(text)


@pytest.mark.parametrize(
    "text", ["ab" * 600_000, " " * 1_200_000, "x" + "\n" * 1_200_000 + "y z", "日本" * 300_000, "word and 12 more.\n" * 90_000, "." * 500_000 + "a"], ids=["letters", "blanks", "lines", "unspaced", "prose", "marks"]
)
def test_very_long_texts(text):
    encoder = m.encoding(PATH, PATTERN)
    ids = m.encoded(encoder, text)
    assert encoder.decode_bytes(ids) == text.encode()
    pieces = regex.findall(PATTERN, text)
    assert len(ids) == sum(n * len(encoder._encode_single_piece(p)) for p, n in {p: pieces.count(p) for p in set(pieces)}.items())


def test_edges(spark):
    schema = "doc_id long, text string, ids string, bytes string"
    assert m.encode(spark.createDataFrame([], schema), PATH, PATTERN).count() == 0
    rows = [(None, None, "x", "y"), (1, "", "x", "y"), (2, "a b", "x", "y"), (2, "a b", "x", "y"), (3, "é<|endoftext|>", "x", "y")]
    both = m.decode(m.encode(spark.createDataFrame(rows, schema), PATH, PATTERN), PATH, PATTERN)
    got = sorted(((r.doc_id or 0), r.ids, bytes(r.bytes)) for r in both.collect())
    assert [(k, b) for k, _, b in got] == [(0, b""), (1, b""), (2, b"a b"), (2, b"a b"), (3, "é<|endoftext|>".encode())]
    assert got[2][1] == plain("a b") and got[4][1] == plain("é<|endoftext|>")
    odd = spark.createDataFrame([(1, None), (2, [None]), (3, [50256]), (4, [-1]), (5, [128])], "k long, ids array<int>")
    assert {r.k: r.bytes and bytes(r.bytes) for r in m.decode(odd, PATH, PATTERN).collect()} == {1: None, 2: None, 3: None, 4: None, 5: m.encoding(PATH, PATTERN).decode_bytes([128])}
    packed = m.decode(m.encode(spark.createDataFrame(rows, schema), PATH, PATTERN, packed=True), PATH, PATTERN)
    assert sorted((r.doc_id or 0, struct.unpack(f"<{len(r.ids) // 4}I", r.ids), bytes(r.bytes)) for r in packed.collect()) == [(k, tuple(ids), b) for k, ids, b in got]
    assert isinstance(m.encoding(PATH, PATTERN), tiktoken.Encoding)
