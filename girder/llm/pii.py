"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. They are greedy and try nothing
twice, so a card behind a phone number is lost with it, and they know neither phones without a plus, nor addresses with
blanks around their signs, nor cards with dots. The random field labels the words around digits and signs by their
shapes, their neighbours' and the words that often stand before an entity. What it finds is added where it has the kind's
form (`FORM`, wider than the patterns) and passes the kind's check (Luhn, digits, parts up to 255; a phone without a plus
has a separator), and does not touch a pattern's span. An entity holds a digit or an `@`, so stretches of text without
them are outside by the labels' grammar and are not decoded; all the rest of every text is.

The field is trained on `pii_labels.TABLE`, some hundred sentences labelled by hand, by full-batch gradient steps on the
driver.

Edge cases: a null text is an empty one and has no spans; repeated rows are handled each by itself; a null doc_id
stays null; an empty table gives no rows; other columns are not read (and are kept by `redacted`).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_labels, shared

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- fixed patterns. Each run of digits or of address signs is tried once from its start, so time is linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(s: str) -> bool:
    d = digits(s)
    if not 16 <= len(d) <= 19:
        return False
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
    return (doubled + sum(map(int, d[-1::-2]))) % 10 == 0


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def is_phone(s: str) -> bool:
    return 8 <= len(digits(s)) <= 15


def base_spans(text: str) -> dict[str, list[Span]]:
    found = lambda pattern, good: [m.span() for m in pattern.finditer(text) if good(m.group())]
    return {"email": emails(text) if "@" in text else [], "ip": found(IP, is_ip), "card": found(CARD, is_card), "phone": found(PHONE, is_phone) if "+" in text else []}


# ---- words and their features
WORD = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\w")
STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Words that often stand before an entity.
CUES = {
    "email": "mail email contact write reply cc schreiben escriba".split(),
    "ip": "ip host ping server port login".split(),
    "card": "card cards carte karte tarjeta visa".split(),
    "phone": "phone phones tel call telefon téléphone teléfono fax cell mobile ring hotline appelez llame number nummer numéro número".split(),
}
CUES = {word: kind for kind, words in CUES.items() for word in words}


def shape(word: str) -> str:
    if "0" <= word[0] <= "9":
        return f"9{min(len(word), 20)}"
    if word.isalpha():
        return "A" if word.isupper() else "Aa" if word[0].isupper() else "a"
    return word if len(word) == 1 and word.isascii() else "?"


def features(text: str, words: list[Span]) -> list[list[str]]:
    """For each word: its shape and its neighbours', and whether blanks lie between them."""
    shapes = ["^", "^", *(shape(text[a:b]) for a, b in words), "$", "$"]
    joined = [False, *(words[i][1] == words[i + 1][0] for i in range(len(words) - 1)), False]
    out = []
    for i, (a, b) in enumerate(words):
        s, j0, j1 = shapes[i : i + 5], "+" if joined[i] else " ", "+" if joined[i + 1] else " "
        cue = next((CUES[w] for k in range(i - 1, max(-1, i - 4), -1) if (w := text[words[k][0] : words[k][1]].lower()) in CUES), "")
        byte = s[2][0] == "9" and b - a <= 3 and int(text[a:b]) <= 255
        out.append([f"0{s[2]}", f"1{s[1]}{j0}{s[2]}", f"2{s[2]}{j1}{s[3]}", f"3{s[1]}{j0}{s[2]}{j1}{s[3]}", f"4{s[0]}{s[1]}{j0}", f"5{j1}{s[3]}{s[4]}", f"6{cue}", f"7{byte}{j0}{j1}", f"8{j0}{j1}"])
    return out


class Field:
    """Weights of features by state, of steps between states and of first states."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.names, self.emit, self.step, self.first = names, emit, step, first

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        none = len(self.names)
        at = np.array([[self.names.get(f, none) for f in row] for row in rows], np.int64)
        return np.vstack([self.emit, np.zeros((1, self.emit.shape[1]))])[at].sum(axis=1)

    def decode(self, emits: list[np.ndarray], cells: int = 200_000) -> list[np.ndarray]:
        """Best states by Viterbi; sequences of like length go together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(emits)
        order = sorted((k for k in range(len(emits)) if len(emits[k])), key=lambda k: len(emits[k]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(emits[order[n]]) <= cells:
                n += 1
            some, order = order[:n], order[n:]
            for k, path in zip(some, self._viterbi([emits[k] for k in some]), strict=True):
                out[k] = path
        return out

    def _viterbi(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(e) for e in emits])
        top, states = lengths.max(), self.step.shape[0]
        grid = np.zeros((top, len(emits), states))
        for k, e in enumerate(emits):
            grid[: len(e), k] = e
        back = np.zeros((top, len(emits), states), np.int8)
        score = grid[0] + self.first
        for t in range(1, top):
            ways = score[:, :, None] + self.step
            back[t] = ways.argmax(axis=1)
            score = np.where((t < lengths)[:, None], ways.max(axis=1) + grid[t], score)
        state = score.argmax(axis=1)
        path = np.zeros((top, len(emits)), np.int64)
        for t in range(top - 1, -1, -1):
            path[t] = state
            state = np.where((t < lengths) & (t > 0), back[t, np.arange(len(emits)), state], state)
        return [path[:n, k] for k, n in enumerate(lengths)]


BARRED = -1e4


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """Bars `I` that does not go on with its own kind."""
    step, first = np.zeros((len(STATES), len(STATES))), np.zeros(len(STATES))
    for j, to in enumerate(STATES):
        if to[0] == "I":
            first[j] = BARRED
            for i, come in enumerate(STATES):
                if come[1:] != to[1:]:
                    step[i, j] = BARRED
    return step, first


def train(table: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 150, rate: float = 0.2, decay: float = 0.02) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam over the whole table at each step."""
    sequences, names = [], {}
    for text, spans in table:
        words = [m.span() for m in WORD.finditer(text)]
        labels = [STATES.index(next((f"{'B' if a == s else 'I'}-{k}" for k, s, e in spans if s <= a and b <= e), "O")) for a, b in words]
        rows = [[names.setdefault(f, len(names)) for f in row] for row in features(text, words)]
        sequences.append((np.array(rows), np.array(labels)))
    top, n, s = max(len(y) for _, y in sequences), len(sequences), len(STATES)
    lengths = np.array([len(y) for _, y in sequences])
    at = np.full((top, n, sequences[0][0].shape[1]), len(names))
    gold = np.zeros((top, n, s))
    for k, (rows, labels) in enumerate(sequences):
        at[: len(rows), k] = rows
        gold[np.arange(len(labels)), k, labels] = 1
    bars, bars_first = grammar()
    seen_steps = np.einsum("tni,tnj->ij", gold[:-1], gold[1:])
    weights = [np.zeros((len(names) + 1, s)), np.zeros((s, s)), np.zeros(s)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    live = (np.arange(top)[:, None] < lengths)[:, :, None]
    for turn in range(1, steps + 1):
        emit, step, first = weights[0][at].sum(axis=2), weights[1] + bars, weights[2] + bars_first
        ahead, behind = np.zeros((top, n, s)), np.zeros((top, n, s))
        ahead[0] = emit[0] + first
        for t in range(1, top):
            ahead[t] = np.where(live[t], _logsum(ahead[t - 1][:, :, None] + step, 1) + emit[t], ahead[t - 1])
        for t in range(top - 2, -1, -1):
            behind[t] = np.where(live[t + 1], _logsum(step + (emit[t + 1] + behind[t + 1])[:, None, :], 2), 0)
        total = _logsum(ahead[-1], 1)
        mean = np.exp(ahead + behind - total[:, None]) * live
        pair = np.zeros((s, s))
        for t in range(top - 1):
            both = ahead[t][:, :, None] + step + (emit[t + 1] + behind[t + 1])[:, None, :] - total[:, None, None]
            pair += (np.exp(both) * live[t + 1][:, :, None]).sum(axis=0)
        off = mean - gold
        grads = [np.zeros_like(weights[0]), pair - seen_steps, off[0].sum(axis=0)]
        np.add.at(grads[0], at, off[:, :, None, :])
        grads[0][-1] = 0
        for w, g, (m1, m2) in zip(weights, grads, moments, strict=True):
            g = g + decay * w
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            w -= rate * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8)
    return Field(names, weights[0][:-1], weights[1] + bars, weights[2] + bars_first)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@functools.cache
def field() -> Field:
    return train(pii_labels.labelled_table())


# ---- whole texts
AROUND = 48
#: Between windows of the text that are decoded, at least so many characters lie without a digit or `@`.


def windows(text: str) -> list[Span]:
    """Stretches around digits and `@`, out to the next white space."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for w in out:
        back = max(text.rfind(" ", 0, w[0] + 1), text.rfind("\n", 0, w[0] + 1))
        w[0] = max(back + 1, w[0] - AROUND) if back >= 0 else max(0, w[0] - AROUND)
    return [(a, b) for a, b in out]


def without_blanks(s: str) -> str:
    return s.replace(" ", "")


#: What the field may add: by form, and by the kind's check once blanks are out.
FORM = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?: ?\. ?[A-Za-z0-9._%+-]+)* ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?: ?\. ?[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9(][\x20()./0-9-]+[0-9]|\(?[0-9]+[\x20()./-][\x20()./0-9-]*[0-9]"),
}
CHECK = {"email": lambda s: emails(without_blanks(s)) == [(0, len(without_blanks(s)))], "ip": lambda s: is_ip(without_blanks(s)), "card": is_card, "phone": is_phone}


def all_spans(texts: list[str | None], model: Field) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """For each text the patterns' spans, and all spans, by kind and in order."""
    out, pieces, rows = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text) if text and TRIGGER.search(text) else {kind: [] for kind in KINDS}
        out.append((base, {kind: list(s) for kind, s in base.items()}))
        for a, b in windows(text) if text else []:
            if words := [(a + m.start(), a + m.end()) for m in WORD.finditer(text[a:b])]:
                pieces.append((k, words))
                rows.append(features(text, words))
    if not rows:
        return out
    scores = model.scores([r for row in rows for r in row])
    paths = model.decode(np.split(scores, np.cumsum([len(r) for r in rows])[:-1]))
    for (k, words), path in zip(pieces, paths, strict=True):
        for kind, a, b in _entities(words, path):
            value, (base, held) = texts[k][a:b], out[k]
            if FORM[kind].fullmatch(value) and CHECK[kind](value) and all(b <= s or e <= a for spans in (*base.values(), held[kind]) for s, e in spans):
                held[kind].append((a, b))
    for _, held in out:
        for spans in held.values():
            spans.sort()
    return out


def _entities(words: list[Span], path: np.ndarray) -> Iterator[tuple[str, int, int]]:
    at = np.flatnonzero(path)
    k = 0
    while k < len(at):
        i = j = at[k]
        kind = STATES[path[i]][2:]
        while k + 1 < len(at) and at[k + 1] == j + 1 and STATES[path[j + 1]] == f"I-{kind}":
            k += 1
            j += 1
        yield kind, words[i][0], words[j][1]
        k += 1


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
RESULT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(field())  # bounded by the labelled table

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = all_spans(part.column(1).to_pylist(), model.value)
            columns = [pa.array([len(base[k]) for base, _ in got], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, digest, pa.array([listed(every) for _, every in got], pa.string())], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT_DDL)


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """Each span replaced by its kind; of spans that overlap, the whole stretch by the first one's."""
    every = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    out, at = [], 0
    for a, b, kind in every:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with personal data replaced in `text`, and `n_chars` counted anew where there is one."""
    model = docs.sparkSession.sparkContext.broadcast(field())
    at = docs.columns.index("text")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).to_pylist()
            clean = [redact(t, every) if t and any(every.values()) else t for t, (_, every) in zip(texts, all_spans(texts, model.value), strict=True)]
            yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return found(shared.documents(spark, sf_dir))
