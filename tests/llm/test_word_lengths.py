"""Tokens of words, counted once each, against those of whole texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from veridact.llm import token_counts


def test_words_add_up_to_whole_texts(monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    asked = []

    def count(texts):
        asked.extend(texts)
        return [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]

    r = random.Random(4)
    parts = ["one", "Two's", "x<|endoftext|>y", "<|startoftext|>", "a\nb", "\n", " ", "é", "́", "ΟΔΟΣ", "12,5", "日本", "…'ll", "'s", "", "\t", "z" * 70]
    texts = ["", " ", "  ", " one", "one ", "one  two"] + ["".join(r.choice(parts) + r.choice([" ", " ", " ", "  ", "\n"]) for _ in range(r.randrange(1, 40))) for _ in range(300)]
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    for most in (1 << 17, 3):
        monkeypatch.setattr(token_counts, "KNOWN_WORDS", most)
        known = {}
        got = [n for at in range(0, len(texts), 50) for n in token_counts.word_lengths(texts[at : at + 50], count, known).tolist()]
        assert got == want
    asked.clear()
    plain, known = [" ".join(r.choice(["red", "green", "blue"]) for _ in range(1000)) for _ in range(20)], {}
    got = token_counts.word_lengths(plain, count, known).tolist() + token_counts.word_lengths(plain, count, known).tolist()
    assert got == [1000] * 40 and sum(map(len, asked)) < 500
