"""Language identification with blended-spectrum presence kernels.

The kernel of two texts counts the n-grams of 1 to `MAX_N` bytes that both have, over the square root of what each
has. Landmark texts give a Nyström feature map K(x, L) W^(-1/2), and one-versus-rest kernel ridge regression on it
gives a value for each language. Texts are scored in batches: one product of the presence matrix with the landmarks,
one with the weights. n-grams that no landmark has cannot add to what two texts share, so the matrix has those of the
landmarks alone; the norm counts all n-grams of a text. Texts are lower-cased and whole.

The classifier is fitted on at most `FIT_ROWS` labelled rows of each language, whole texts of up to `FIT_CHARS`
characters, of which `LANDMARKS` are landmarks: those with the smallest hash of doc_id, whatever the order of the rows.

Edge cases: a text that is null or has no letter is `und` with score 0; without any labelled rows all are `und`; repeated
rows are predicted alike; a null doc_id is neither learned from nor held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAX_N = 3
LANDMARKS = 24
FIT_ROWS = 192
#: Rows for fitting are texts of at most so many characters, which bounds what the driver gets.
FIT_CHARS = 1 << 18
RIDGE = 1e-2
BATCH_TEXTS = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def codes(text: str, max_n: int = MAX_N) -> list[np.ndarray]:
    """The n-grams of the lower-cased text as integers below 256^n, for each n; n bytes, with blanks at both ends."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.int32)
    out, held = [raw], raw
    for _ in range(1, max_n):
        held = held[:-1] * 256 + raw[len(raw) - len(held) + 1 :]
        out.append(held)
    return out


class Spectrum:
    """Presence of the n-grams that the landmarks have, over the square root of the number of all n-grams of the text."""

    def __init__(self, grams: list[np.ndarray]):
        self.places, first = [], 0
        for n, known in enumerate(grams, 1):
            place = np.full(256**n, -1, np.int32)
            place[known] = np.arange(first, first + len(known), dtype=np.int32)
            self.places.append(place)
            first += len(known)
        self.size = first

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row for each text; the product of two rows is the kernel, if one of them is a landmark's."""
        out = np.zeros((len(texts), self.size + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            n = 0
            for place, code in zip(self.places, codes(text, len(self.places)), strict=True):
                code = np.unique(code)
                n += len(code)
                row[place[code]] = 1  # an unknown n-gram goes to the last column
            row /= np.sqrt(max(1, n))
        return out[:, : self.size]


class Classifier:
    """Fitted on texts and their languages; `grams`, landmarks and weights are small arrays."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        chosen = [i for lang in self.langs for i in [k for k, x in enumerate(langs) if x == lang][:landmarks]]
        self.grams = []
        for n in range(MAX_N):
            self.grams.append(np.unique(np.concatenate([np.unique(codes(texts[i])[n]) for i in chosen])).astype(np.int32))
        spectrum = Spectrum(self.grams)
        marks = spectrum.presence([texts[i] for i in chosen]).astype(np.float64)
        values, vectors = np.linalg.eigh(marks @ marks.T)
        good = values > 1e-8 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])  # W^(-1/2) on the space that W spans
        rows = np.concatenate([spectrum.presence(texts[i : i + BATCH_TEXTS]) for i in range(0, len(texts), BATCH_TEXTS)])
        features = np.hstack([rows @ marks.T.astype(np.float32) @ root, np.ones((len(rows), 1))])
        # each language counts alike, however many rows it has
        target = np.array([[1.0 if x == lang else -1.0 for lang in self.langs] for x in langs])
        weight = np.array([len(langs) / len(self.langs) / langs.count(x) for x in langs])[:, None]
        gram = features.T @ (weight * features) + ridge * np.eye(features.shape[1])
        solved = np.linalg.solve(gram, features.T @ (weight * target))
        self.marks = marks.astype(np.float32)
        self.weights = (root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def score(self, spectrum: Spectrum, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of the largest value, and how it stands among all values, between 0 and 1."""
        values = (spectrum.presence(texts) @ self.marks.T) @ self.weights + self.bias
        best = values.argmax(axis=1)
        share = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        return [self.langs[k] for k in best], 1 / share.sum(axis=1)


def fitting_rows(docs: DataFrame, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """Text and language of at most `rows` documents of each language: those with the smallest hashes.

    The share to take follows from the count of each language, so the driver gets a bounded number of rows; it is a
    little more than needed, and the driver keeps the smallest.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= FIT_CHARS) & ~held_out(F.col("doc_id"))).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, (rows + 4 * rows**0.5 + 16) / n))).otherwise(limit)
    got = known.where(F.col("h") < limit).select("lang", "h", "doc_id", "text").collect()
    out: list[tuple[str, str]] = []
    for lang in sorted(counts):
        mine = sorted((r for r in got if r["lang"] == lang and LETTER.search(r["text"])), key=lambda r: (r["h"], r["doc_id"], r["text"]))
        out += [(r["text"], lang) for r in mine[:rows]]
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
RESULT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"


def fitted(docs: DataFrame, rows: int = FIT_ROWS) -> Broadcast[Classifier | None]:
    """The classifier of `docs` (doc_id, text, lang), sent to all executors."""
    known = fitting_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")), rows)
    model = Classifier([t for t, _ in known], [x for _, x in known]) if known else None
    return docs.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams: bounded by the parameters above


def labelled(parts: Iterable[pa.RecordBatch], model: Classifier | None, column: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Each batch with the languages and scores of its texts, which are in `column`."""
    spectrum = Spectrum(model.grams) if model else None
    for part in parts:
        texts = part.column(column).to_pylist()
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
        for k in range(0, len(lettered), BATCH_TEXTS):
            at = lettered[k : k + BATCH_TEXTS]
            found, score = model.score(spectrum, [texts[i] for i in at])
            scores[at] = score
            for i, lang in zip(at, found, strict=True):
                langs[i] = lang
        yield part, langs, scores


def predict(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    sent = fitted(docs, rows)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in labelled(parts, sent.value, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(scores)], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, RESULT_DDL)


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the operator gives a language, with all their columns.

    Texts that are null or without a letter are rejected. Rows are judged as they pass, with all their columns: nothing
    is joined, so neither doc_id nor a row's place in a scan need tell rows apart.
    """
    sent, at = fitted(docs), docs.columns.index("text")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, _ in labelled(parts, sent.value, at):
            yield part.filter(pa.array([lang != UNKNOWN for lang in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return predict(shared.documents(spark, sf_dir))
