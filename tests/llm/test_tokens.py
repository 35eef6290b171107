import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from mendseq.llm import chunk_bpe, packing, tokens
from tests.llm.data import documents, empty

ODD = ["", " ", "a  b", "a   b", "x \n\n y", "\t a\t \tb", "end ", "<|endoftext|> a<|endoftext|>b <|end", "é́   x　y",
       "a\r\n b\x85c", "\0 a\0b", "'s it's 12 3,4!!  ??", "\n\n", "漢字 かな", "a\x1cb \x1d c", "ΣΑΣ ΟΔΟΣ", "İstanbul ſt"]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_units_give_the_same_ids(kind):
    if kind == "byte":
        units = tokens.unit_ids("byte_bpe_50k.json", "I", "byte_bpe_50k.tiktoken")
        ids = lambda t: np.frombuffer(tokens.byte_level_ids(t, units), "<u4").tolist()
    else:
        units = tokens.unit_ids("word_bpe_49k.json", "H")
        ids = lambda t: np.frombuffer(tokens.word_ids(t, units), "<u2").tolist()
    rng = random.Random(2)
    letters = "ab Zé\n\t .,'19<|>ßs"
    for text in ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]:
        assert ids(text) == units.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_are_content_defined():
    rng = random.Random(3)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    a, b = chunk_bpe.chunks("é" + body), chunk_bpe.chunks("something else first " + body)
    assert b"".join(a).decode() == "é" + body
    assert len(set(a) & set(b)) > len(a) * 0.7


def test_encode_like_the_library(spark):
    docs = documents(spark)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in chunk_bpe.encode(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert chunk_bpe.encode(empty(docs)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = documents(spark)
    before = sorted(map(str, chunk_bpe.encode(docs).collect()))
    monkeypatch.setattr(chunk_bpe, "FILTER_BITS", (64, 64))
    assert sorted(map(str, chunk_bpe.encode(docs).collect())) == before


def test_pieces_and_packing(spark):
    docs = documents(spark)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    total = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == total
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= -(-total // packing.CAPACITY) + 1
    assert packing.pack_documents(empty(docs)).count() == 0


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_local_search_empties_bins():
    # Best fit leaves three bins; the items fit in two only after swaps.
    sizes, capacity = [4, 4, 3, 3, 3, 3], 10
    worst = [[0, 1], [2, 3, 4], [5]]
    found = packing.local_search(worst, sizes, capacity)
    assert len(found) == 2 and sorted(i for b in found for i in b) == list(range(6))
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        first = packing.best_fit(sizes, 60)
        found = packing.local_search(first, sizes, 60)
        assert len(found) <= len(first) and sorted(i for b in found for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 60 for b in found)
