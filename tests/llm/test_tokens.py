"""Token ids word by word against the library's own, over all letters."""

import sys

import numpy as np
import pytest

from girder.llm import tokens


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return tokens.WordEncoder(), Tokenizer.from_file(tokens.default_path())


def differing(both, texts):
    encoder, library = both
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    return [t for t, a, b in zip(texts, encoder.encode_batch(texts), want, strict=True) if a != b]


def test_letters_that_normalise_to_more_than_letters(both):
    assert differing(both, ["aİ,", "İLİ.", "AİLESİ, x", "İ", "İ. İ!", "x İstanbul'da, 3", "é, É.", "ΑΣ, ΣΑΣ.", "ﬁn, ǅ. ŉ!", "한글, ＡＢ．", "́a, b́"]) == []


def test_every_letter_before_signs(both):
    letters = [c for k in range(sys.maxunicode) if not 0xD800 <= k < 0xE000 and (c := chr(k)).isalpha()]
    assert len(letters) > 100_000
    assert differing(both, [f"a{c},b {c}. {c}" for c in letters]) == []


def test_random_mixtures(both):
    rng = np.random.default_rng(5)
    signs = "abzAİıßéÉé̇ΣσςﬁΩ中१1٣., \n\t ;:!?|%$&*#'-_ 'sx"
    texts = ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 24))) for _ in range(20_000)]
    assert differing(both, texts) == []
