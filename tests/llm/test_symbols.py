"""The symbol coder of the packing operator against the tokenizer library."""

from __future__ import annotations

import random

import pytest

from rollumen.llm import packing, symbols
from rollumen.llm.queries import tokenizer_file

PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "don't", "x''s", "!'s", "'s's", "<|endoftext|>", "a<|startoftext|>b", "1's", "it'S ", "aaa" * 5, "é's", "l'é"]
ODD = "abcABC012'''..,!?-_<>|\"éàüßñÉÈ«»“”’…–İĲǅ²½ªµ́ \u0085​\x1c\x00\x7f中ж😀\n\t \r"


@pytest.fixture(scope="module")
def words():
    return packing.Words(tokenizer_file("word_bpe_49k.json"))


def same(words, texts):
    ids, edges = words.encode_all(texts, 2)
    want = words.own.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [w.ids + [2] for w in want]


def test_against_the_library(words):
    assert words.coder is not None
    r = random.Random(3)
    same(words, ["".join(r.choice(ODD) for _ in range(r.randrange(50))) for _ in range(4000)])
    same(words, ["".join(r.choice(PIECES) + r.choice(["", "", " "]) for _ in range(8)) for _ in range(2000)])
    letters = "aaaeeiostrnlhdbcfgjkmpquvwxyz"
    same(words, [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 15))) for _ in range(30)) for _ in range(2000)])
    same(words, ["", "\n", "a" * 5000, "ab " * 10 + "x" * 300 + "'s", "é" * 250, "中" * 400])


def test_long_texts_in_parts(words, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 40)
    r = random.Random(4)
    same(words, ["".join(r.choice(ODD + "      ") for _ in range(900)) for _ in range(30)] + ["", "x" * 300])


def test_every_token_is_what_its_characters_encode_to(words):
    """What makes the lowest rank first the same as the order of merges: each token is reached from its own symbols."""
    import json

    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
    seq = {ids[t]: (ids[t],) for t in ids if ids[t] < 512}
    for a, b in merges:
        seq[ids[a + b]] = seq[ids[a]] + seq[ids[b]]
    for token, symbols_ in seq.items():
        own = list(symbols_)
        while len(own) > 1:
            best = min((rank.get(p, 1 << 30), k) for k, p in enumerate(zip(own, own[1:])))
            if best[0] == 1 << 30:
                break
            own[best[1] : best[1] + 2] = [best[0]]
        assert own == [token]


def test_other_files_go_to_the_library(tmp_path):
    import json

    path = tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    assert symbols.Coder.of_file(str(other)) is None
    words = packing.Words(str(other))
    same(words, ["It's A text", "", "a b"])
