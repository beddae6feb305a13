"""Encoding of new words many at a time: the ids of the library on whole texts, and few calls."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from armlight.llm.id_files import LibraryEncoder

PARTS = [
    "a", "word", "Word", "WORD", "été", "ÉTÉ", "H̱", "ẖ", "ẖְ", "É", "İ", "İ", "K", "Σ", "ΑΣ", "ß", "x×y", "don't",
    "DON'T", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "", "12a3", "日本", "a日 b", "́", "_", "--", "…", "\x1c", " ",
    "　", "​", "😀",
]
BLANKS = ["", " ", "  ", "\n", "\t", " \n ", "\r\n", "\x0b"]
KINDS = [("word_bpe_49k.json", {"by_pieces": True, "fold": True}), ("byte_bpe_50k.json", {})]


@pytest.mark.parametrize("name, options", KINDS)
def test_ids_are_those_of_whole_texts(name, options):
    rng = random.Random(3)
    texts = ["", "A", " A", "A ", None]
    for _ in range(600):
        texts.append("".join(rng.choice(PARTS) + rng.choice(BLANKS) for _ in range(rng.randrange(30))))
    texts += ["".join(rng.choice("abcdEFGHéÀ") for _ in range(rng.randrange(1, 9))) + " tail" for _ in range(600)]
    encoder, whole = LibraryEncoder(public_tokenizers.path(name), **options), Tokenizer.from_file(public_tokenizers.path(name))
    whole.no_truncation()
    whole.no_padding()
    for size in (1, 7, len(texts)):
        for at in range(0, len(texts), size):
            some = texts[at : at + size]
            ids, sizes = encoder.encode(pa.array(some, pa.string()))
            found = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
            assert found == [whole.encode(t or "", add_special_tokens=False).ids for t in some]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)

    def get_vocab(self):
        return self.tokenizer.get_vocab()


@pytest.mark.parametrize("name, options", KINDS)
def test_new_words_are_encoded_many_as_one_text(name, options):
    encoder = LibraryEncoder(public_tokenizers.path(name), **options)
    encoder.tokenizer = Counting(encoder._library())
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzéèàü"]
    encoder.encode(pa.array([" " + " ".join(words)]))
    assert encoder.tokenizer.texts <= 20


def test_words_that_differ_in_case_or_blanks_are_one_piece():
    encoder = LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"), by_pieces=True, fold=True)
    encoder.encode(pa.array(["word Word WORD", "word\nword\tWoRd"]))
    assert [p for p in encoder.cache.recent if p] == ["word"]
