"""Alignment of two tokenizers against a brute force over byte ranges of both libraries' tokens."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strikelake.llm import alignment
from strikelake.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, c0 long, pairs int"
TEXTS = [
    None, "", " ", "one", "The quick brown fox's jumps, over 12345 lazy dogs!  Two  spaces\n\nand\tlines ", " leading", "été naïve Straße ñandú ça", "日本語のテキスト と 英語 mixed", "\U0001f600\U0001f469‍\U0001f680 emoji",
    "bad ▁ mark", "<|endoftext|> <s> </s> <unk> <0x0A>", "\x00\x01 control", "AAAA" * 60, "the the the the the of the", "á ë", "x" + " " * 40 + "y", "ĂÎ nbsp　wide",
]


def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    symbols = byte_symbols()
    label_a = lambda i: bytes(symbols[c] for c in a.id_to_token(i))
    label_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, label_a, label_b


def brute(texts):
    a, b, label_a, label_b = libraries()
    out, counts = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(label_a, ids_a)) != want or b"".join(map(label_b, ids_b)) != want:
            out.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(label(i)) for i in ids]).tolist() for label, ids in ((label_a, ids_a), (label_b, ids_b)))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        links, j = [], 0
        for x, (s, e) in zip(ids_a, zip([0, *ends_a], ends_a)):
            links += [(x, y) for y, (s2, e2) in zip(ids_b, zip([0, *ends_b], ends_b)) if s < e2 and s2 < e]
        counts.update(links)
        out.append((len(ids_a), len(ids_b), groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), ";".join(r[2])) for r in out]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return alignment.align(docs, A, B, carry=["doc_id", "block", "c0"], **options)


def check(found, rows):
    want = collections.Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    assert found.columns == ["doc_id", "block", "c0", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    got = found.collect()
    assert {r.block for r in got} == {"x"} and {r.c0 for r in got} == {1}
    assert collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == want


def test_alignment_equals_brute_force(spark):
    rows = [(i * 7 % 31, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "x", 1, 2), (28, TEXTS[4], "x", 1, 2)]
    check(run(spark, rows), rows)


def test_registered_texts_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    check(run(spark, rows), rows)


def test_parts_and_blocks(monkeypatch):
    """Texts in many pieces over many blocks, with the hash of windows colliding: the same as in one go."""
    monkeypatch.setattr(alignment, "_hashes", lambda values, starts, sizes: sizes.astype(np.uint64) % np.uint64(2))
    aligner = alignment.Aligner(alignment.ByteBpe(open(A, "rb").read()), alignment.Pieces(open(B, "rb").read()))
    text = " ".join(TEXTS[4:9]) * 5
    pieces = alignment.pieces_of(text, True, 40)
    assert len(pieces) > 10 and " ".join(pieces) == text and alignment.pieces_of(text, False, 40) == [text]
    whole = aligner.tokens(text)
    parts = [alignment.Part(0, *aligner.tokens(p)) for p in pieces]
    assert all((np.concatenate([getattr(p, side) for p in parts]) == ids).all() for side, ids in zip("ab", whole))
    found = aligner.windows(parts)
    groups = "".join(found.groups[i] for i in found.number)[:-1]
    assert groups == brute([text])[0][-1] and int(found.n_groups[found.number].sum()) == groups.count(";") + 1


def test_long_texts_over_blocks(spark, monkeypatch):
    texts = [" ".join(f"w{i % 97} été{i % 13}" for i in range(600)), "short one", " ".join(f"q{i}" for i in range(300)) + " ▁"]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    small = alignment.pieces_of
    plain = [tuple(r) for r in alignment.align(docs, A, B, carry=["doc_id"]).orderBy("doc_id").collect()]
    digests = {r.doc_id: r.groups for r in alignment.align(docs, A, B, carry=["doc_id"], digest=True).collect()}
    assert digests == {r[0]: hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "" for r in plain}
    assert [(r[0], *r[1:5], *r[6:], r[5]) for r in plain] == [(i, *w) for i, w in enumerate(brute(texts))]
    assert small(texts[0], True) == [texts[0]]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B, carry=["doc_id"]).count() == 0


@pytest.mark.parametrize("text", ["x" * 5000, "日本" * 3000])
def test_texts_without_spaces(text):
    aligner = alignment.Aligner(alignment.ByteBpe(open(A, "rb").read()), alignment.Pieces(open(B, "rb").read()))
    found = aligner.windows([alignment.Part(0, *aligner.tokens(text))])
    assert "".join(found.groups[i] for i in found.number)[:-1] == brute([text])[0][-1]
