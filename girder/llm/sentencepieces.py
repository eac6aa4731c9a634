"""SentencePiece encoding by Viterbi over shared prefixes, and decoding.

A text becomes marked words: blanks turn into the mark, one mark is put in front, and each word keeps the marks
before it. No piece goes on past the end of a word, so the best segmentation of a text is that of its words. Distinct
words are sorted; a word shares the forward scores of the prefix it has in common with the word before, which is a
depth-first walk through the trie of the words, and the pieces that end at a place are found by walking the trie of the
reversed vocabulary... once for each new letter, never again for a shared one.

The score of a piece is the one that the model file gives, and the segmentation with the largest sum is taken; of equal
sums the one with the longer last piece. The file bars the mark and its runs with scores that would swamp the sums; here
the mark has the score of its place in the file, between those of its neighbours, and a run that of its marks one by
one, so that the longer piece is taken. A letter that no piece covers costs `UNKNOWN` below the lowest score and is
written as its UTF-8 bytes, one byte piece each; as no piece of one letter scores below the lowest, a letter that has a
piece is never written so. A mark that the text itself has is written as its bytes too, so that it does not come back as
a blank. (The file at hand was made for merging by rank: ids here are those
of the best-sum segmentation of its pieces, and decode to the same text.)

Edge cases: null and empty texts have no pieces; repeated rows are encoded again; a null doc_id stays null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MARK = "▁"
#: Stands for a mark that the text itself has; no valid text holds a lone surrogate.
OWN_MARK = "\udcff"
#: Score of an uncovered letter, below the lowest score of the model.
UNKNOWN = -10.0
#: Words whose ids a worker remembers; past this many it forgets all.
REMEMBERED = 400_000
#: Pieces that the model bars score so low that they would swamp the sums; they get other scores (`usable`).
BARRED = -1e8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def marked_words(text: str) -> list[str]:
    """Words with the marks before them; joined they are the marked text. Marks at the end are a word."""
    if not text:
        return []
    whole = MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)
    out, start = [], 0
    while start < len(whole):
        end = start
        while end < len(whole) and whole[end] == MARK:
            end += 1
        end = whole.find(MARK, end)
        end = len(whole) if end < 0 else end
        out.append(whole[start:end])
        start = end
    return out


def usable(names: dict[int, str], scores: dict[int, float], unknown: float) -> dict[int, float]:
    """The scores, but for barred pieces: one letter has that of its place among the ids, more letters have their sum."""
    known = sorted(i for i, s in scores.items() if s > BARRED)
    out = {i: s if s > BARRED else float(np.interp(i, known, [scores[k] for k in known])) for i, s in scores.items() if s > BARRED or len(names[i]) == 1}
    letters = {names[i]: s for i, s in out.items() if len(names[i]) == 1}
    return {i: out[i] if i in out else sum(letters.get(c, unknown) for c in names[i]) for i in scores}


class Pieces:
    """The vocabulary, and the segmentation of sorted words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        self.text = {i: p for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        scores = {i: model.get_score(i) for i in self.text}
        low = min((s for s in scores.values() if s > BARRED), default=0.0)
        self.unknown = low + UNKNOWN
        # the trie of reversed pieces: [children, id, score]; from a place in a word it is walked backwards
        self.root: list = [{}, -1, 0.0]
        scores = usable(self.text, scores, self.unknown)
        for i, piece in self.text.items():
            node = self.root
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = i, scores[i]
        self.known: dict[str, bytes] = {}

    def segment_sorted(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word of a sorted list with its ids. Forward scores of a shared prefix are kept from the word before."""
        best, back, last = [0.0], [(0, -1)], ""
        for word in words:
            shared_to = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                shared_to += 1
            del best[shared_to + 1 :], back[shared_to + 1 :]
            for end in range(shared_to + 1, len(word) + 1):
                top, way = best[end - 1] + self.unknown, (end - 1, -1)
                node, at = self.root, end - 1
                while at >= 0 and (node := node[0].get(word[at])) is not None:
                    if node[1] >= 0 and (value := best[at] + node[2]) >= top:
                        top, way = value, (at, node[1])
                    at -= 1
                best.append(top)
                back.append(way)
            last = word
            ids, end = [], len(word)
            while end:
                start, piece = back[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [self.byte[b] for b in reversed(word[start:end].replace(OWN_MARK, MARK).encode("utf-8", "replace"))]
                end = start
            yield word, ids[::-1]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [marked_words(t or "") for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*cut)
        for word, ids in self.segment_sorted(sorted(new)):
            self.known[word] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces with marks turned into blanks, runs of byte pieces read as UTF-8, the first blank dropped."""
        table = self.bytes_of()
        return b"".join(table[i] for i in ids).decode("utf-8", "replace")[1:]

    def bytes_of(self) -> dict[int, bytes]:
        """What each id stands for; a mark that a text itself has is in byte pieces, and stays a mark."""
        return {i: p.replace(MARK, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for b, i in self.byte.items()}


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decodes", pa.bool_())])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """For each document the number of its pieces, the crc32 of their ids and whether they decode to the text."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        table = np.zeros(max([*model.text, *model.byte.values()]) + 1, object)
        for i, raw in model.bytes_of().items():
            table[i] = raw
        for part in parts:
            texts = part.column(1).to_pylist()
            ids = model.encode_batch(texts)
            back = [b"".join(table[np.frombuffer(x, "<u4")].tolist()).decode("utf-8", "replace")[1:] for x in ids]
            same = [b == (t or "") for b, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decodes boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return encoded(shared.documents(spark, sf_dir), default_path())
