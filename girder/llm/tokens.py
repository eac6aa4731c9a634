"""Token ids of whole texts, word by word, through the tokenizers library."""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: The id that ends a document.
END_ID = 2
END = np.uint32(END_ID).tobytes()
#: Parts of texts, and bare words, whose ids a worker remembers in each of two generations.
PARTS, WORDS = 700_000, 400_000
#: Signs that may end a part; with letters alone before them, the vocabulary always cuts there.
SIGNS = ".,;:!?|%$&*#"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Ids by string, in two generations: what is not met while one fills up is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def missing(self, keys: set[str]) -> set[str]:
        """Keys not met in either generation; those of the old one move to the young."""
        new = keys.difference(self.young)
        known = {k: self.old[k] for k in new if k in self.old}
        self.young.update(known)
        return new.difference(known)


def only_letters(word: str) -> bool:
    """Whether a word is letters alone, and still is once the normaliser has composed and lower-cased it.

    A capital dotted I turns into a letter and a mark; the vocabulary cuts before the mark, which then joins the signs
    behind the word.
    """
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space before it looks for words, and neither its normaliser nor its
    merges reach across a blank or a line end. So the ids of a text are the ids of its parts between
    blanks and line ends, one after another, and parts met before need not be encoded again. Nor does a
    merge reach from letters to the signs behind them if the letters are still letters when normalised
    (`only_letters`), and ASCII letters are lower-cased: so the parts `Word`, `word` and `word,` share the ids of one
    bare word. All other parts are encoded whole. A null or empty text has no ids.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.parts, self.words = Memory(PARTS), Memory(WORDS)
        self.signs: dict[str, bytes] = {"": b""}

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        self.parts.turn()
        if new := self.parts.missing(set().union(*cut)):
            self._learn(new)
        ids = self.parts.young.__getitem__
        return [b"".join(map(ids, parts)) for parts in cut]

    def forget(self) -> None:
        """Give memory back, where the worker goes on to other work."""
        self.parts.clear()
        self.words.clear()

    def _learn(self, new: set[str]) -> None:
        parts = list(new)
        bare = [p.rstrip(SIGNS) for p in parts]
        kind = list(map(only_letters, bare))
        odd = [p for p, k in zip(parts, kind, strict=True) if not k]
        words = [w.lower() if w.isascii() else w for w, k in zip(bare, kind, strict=True) if k]
        parts = [p for p, k in zip(parts, kind, strict=True) if k]
        self.words.turn()
        if fresh := list(self.words.missing(set(words))):
            self.words.young.update(zip(fresh, self._bare(fresh), strict=True))
        ids = list(map(self.words.young.__getitem__, words))
        tails = [p[len(w) :] for p, w in zip(parts, words, strict=True)]
        if signs := list(set(tails).difference(self.signs)):
            self.signs.update(zip(signs, self._each(signs), strict=True))
        self.parts.young.update(zip(parts, map(bytes.__add__, ids, map(self.signs.__getitem__, tails)), strict=True))
        self.parts.young.update(zip(odd, self._each(odd), strict=True))

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _bare(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters. Many go in one string; each ends at the one id that ends a word."""
        out = []
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):  # not one end for each word: an alphabet that the vocabulary cuts otherwise
                out += self._each(some)
                continue
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[at:end])
                at = end
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; its memory of words lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
