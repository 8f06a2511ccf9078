"""The encoder's bounds don't change its ids: a tiny byte table, arc table and word cache against the library."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from strikelake.llm import bpe


def test_tiny_tables_give_the_same_ids(monkeypatch):
    for name, value in (("TABLE_STATES", 7), ("TABLE_ARCS", 5), ("CACHE_WORDS", 3), ("CACHED_SIZE", 4)):
        monkeypatch.setattr(bpe, name, value)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.read_tokenizer(path))
    rng = random.Random(4)
    texts = ["internationalisation " * 20, "x" * 3000, "Straße, naïve; 12345 日本語 \U0001f600", "".join(rng.choice("etaoinshr dlu") for _ in range(4000))]
    for text in texts:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.words) <= 3 and len(encoder.words.machine.table) <= 5 and len(encoder.words.machine.content) <= 8
