"""How much the encoder of op7 does for a text, and that its ways of splitting agree."""

import cProfile
import pstats
import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tokenizers

from deltashelf.llm import bpe


def test_calls_a_word():
    """Calls don't depend on the machine: under 16 for each of a text's words, all new words among them."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()[:400]]
    tok = bpe.WordTokenizer(P.path("word_bpe_49k.json"))
    words = sum(len(tok.words(tok.normal(t))) for t in texts)
    p = cProfile.Profile()
    p.enable()
    for t in texts:
        tok.digests(t)
    p.disable()
    assert pstats.Stats(p).total_calls / words < 16, pstats.Stats(p).total_calls / words


def test_narrow_texts_are_split_as_all_others():
    tok, r = bpe.WordTokenizer(P.path("word_bpe_49k.json")), random.Random(3)
    texts = ["".join(chr(r.choice((r.randrange(256), r.choice(b"'abstredmv l0_")))) for _ in range(200)) for _ in range(500)] + [f"a{chr(c)}b{chr(c)}{chr(c)} 1{chr(c)}'s" for c in range(256)]
    for t in map(tok.lower, texts):
        assert tok.split_narrow.findall(t) == tok.split_any.findall(t)
        if not bpe.odd_number(t):
            assert tok.split_plain.findall(t) == tok.split_any.findall(t)


def test_forgetting_changes_nothing(monkeypatch):
    """With hardly any memory of words, pairs and steps the ids stay the library's."""
    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(bpe.Merges, "KEEP", 50)
    tok, library, r = bpe.WordTokenizer(path, keep=7), tokenizers.Tokenizer.from_file(path), random.Random(4)
    for _ in range(60):
        t = " ".join("".join(r.choice("thenaouciónßé'") for _ in range(r.choice((3, 9, 14, 300)))) for _ in range(20))
        assert tok.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert len(tok.known) <= 7 and len(tok.known.older) <= 7 and tok.merges.kept <= 50 and tok.merges.steps <= 50


def test_a_splitter_of_another_kind_is_refused(tmp_path):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    at = tmp_path / "other.json"
    at.write_text(spec.replace(r"[\\p{N}]", r"[\\p{N}]+"), encoding="utf-8")
    with pytest.raises(ValueError, match="another kind"):
        bpe.WordTokenizer(str(at))
