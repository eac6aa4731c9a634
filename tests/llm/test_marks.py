"""The mark and its runs are pieces like others."""

import pytest

from girder.llm import sentencepieces

MARK = sentencepieces.MARK


@pytest.fixture(scope="module")
def model():
    return sentencepieces.pieces(sentencepieces.default_path())


def ids(model, word):
    return dict(model.segment_sorted([word]))[word]


def test_a_bare_mark_is_one_piece(model):
    names = {p: i for i, p in model.text.items()}
    assert ids(model, "▁ñga") == [names["▁"], names["ñ"], names["ga"]]
    assert ids(model, "▁") == [names["▁"]]
    assert ids(model, "▁▁▁the") == [names["▁▁"], *ids(model, "▁the")]


def test_each_run_of_marks_comes_out(model):
    runs = {len(p): i for i, p in model.text.items() if set(p) == {MARK}}
    assert sorted(runs) == [*range(1, 15), 16]
    for n, piece in runs.items():
        assert ids(model, MARK * n) == [piece]
    for n in range(17, 60):
        assert model.decode(ids(model, MARK * n)) == " " * (n - 1) and not set(ids(model, MARK * n)) & set(model.byte.values())


def test_every_piece_of_one_letter_beats_its_bytes(model):
    letters = {p: i for i, p in model.text.items() if len(p) == 1}
    assert all(found == [letters[p]] for p, found in model.segment_sorted(sorted(letters)))
    assert all(i in model.byte.values() for i in ids(model, "\U0001f9ff"))  # no piece has this letter


def test_blanks_of_a_text(model):
    texts = ["", " ", "  a", "a   b", "     x", "a          ", "a " * 40 + " " * 40, "ñga ñga", "\n  \n", "▁ ▁", "a▁b", "▁▁a ▁"]
    for text in texts:
        (raw,) = model.encode_batch([text])
        got = [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]
        assert model.decode(got) == text
        assert any(model.byte[b] in got for b in MARK.encode()) == (MARK in text)
