"""Pieces that a worker has encoded are kept for its later tasks."""

import public_tokenizers as P

from waymerge.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def test_pieces_are_encoded_once_a_worker(monkeypatch):
    text = "Unfrequented qwrtzplk words, qwrtzplk again"
    first = bpe.coder(PATH, P.PATTERN)(text)
    monkeypatch.setattr(bpe.Vocabulary, "encode", lambda self, piece: 1 / 0)
    assert bpe.coder(PATH, P.PATTERN)(text) == first and first[1] == text.encode()
