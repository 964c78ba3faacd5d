"""Words as packing remembers and cuts them, against the vocabulary's own tokenizer."""

import struct

import public_tokenizers

from lorekeep.llm import packing


def test_words_are_remembered_and_marks_cut_like_the_vocabulary(monkeypatch):
    ours = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    marks = " ".join(f"{w}{m}" for w in ("Ab", "zoo", "ß", "x1", "") for m in [*map(chr, range(33, 127)), "<|", "|>", ""])
    for text in (marks, "it's 'a' a.b. a.. <|endoftext|> é. Éa, ,"):
        ids = ours.whole.encode(text, add_special_tokens=False).ids
        assert ours.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:10]).encode()  # 175,760
    first, asked = ours.encode(words), []
    ours.encode(b"one more")
    monkeypatch.setattr(ours, "piece", lambda piece: asked.append(piece) or b"")
    assert ours.encode(words) == first and not asked  # before: all were forgotten
