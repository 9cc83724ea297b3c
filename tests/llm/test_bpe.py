"""Encoding against the tokenizer library, decoding as a round trip."""

import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymerge.llm.bpe import Vocabulary, decode_documents, encode_documents, encoder

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Vocabulary(PATH).ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return encoder(PATH, P.PATTERN)[0]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80) | st.text("ab eE'st\né中1 ½\x1c\x85", max_size=200))
def test_equals_library(library, own, text):
    assert own(text)[0] == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_999, "中文" * 3_000, "x1" * 500 + " " * 5_000 + "y", "=" * 7_001, "thethethe" * 700, "\U0001f600" * 999])
def test_long_pieces(library, own, text):
    assert own(text)[0] == library.encode_ordinary(text)


def test_rows(spark, library):
    texts = [None, "", "A b\n\nc  d", "<|endoftext|>", "It's 12,5 € " * 50, "It's 12,5 € " * 50]
    docs = spark.createDataFrame([(i if i else None, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    encoded = encode_documents(docs, PATH, with_ids=True)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = set()
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.add((i or None, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == want
    assert sorted((r.doc_id or 0, r.text) for r in decode_documents(encoded, PATH).collect()) == [(i, t or "") for i, t in enumerate(texts)]
    assert encode_documents(docs.limit(0), PATH).count() == 0
