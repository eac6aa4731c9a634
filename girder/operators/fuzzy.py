"""What has no built-in form, over Arrow batches: sequence ratio, broken JSON, compatibility normal form."""

from __future__ import annotations

import difflib
import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(known: Sequence[str], least: float):
    """A Column function: the known word with the best sequence ratio, where that is `least` or more."""
    words = list(known)

    def one(text: str | None) -> str | None:
        if not text:
            return None
        skeleton = "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())
        ranked = [(difflib.SequenceMatcher(None, skeleton, w.lower()).ratio(), -k) for k, w in enumerate(words)]
        ratio, k = max(ranked)
        return words[-k] if ratio >= least else None

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        found = {x: one(x) for x in column.dropna().unique()}
        return column.map(found).astype(object)

    return run


def complete_objects(text: str, field: str = "rows") -> list[str]:
    """The complete top-level objects of the field's array in a JSON text that breaks off.

    A closing brace too many is passed over. An array that closes properly has nothing to salvage.
    """
    at = text.find(f'"{field}"')
    at = text.find("[", at) if at >= 0 else -1
    out, depth, start, quoted, escaped = [], 0, -1, False, False
    for k in range(at + 1 if at >= 0 else len(text), len(text)):
        c = text[k]
        if quoted:
            quoted, escaped = (escaped or c != '"'), (not escaped and c == "\\")
        elif c == '"':
            quoted = True
        elif c == "{":
            start, depth = (k if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : k + 1])
        elif c == "]" and depth == 0:
            return []
    return out


def salvaged(column: Column) -> Column:
    """JSON texts of the objects that can be read: of a whole text those of its rows, else what can be salvaged."""

    def good(text: str) -> list[str]:
        out = []
        try:
            whole = json.loads(text[text.find("{") :])["rows"]
            return [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in whole if isinstance(x, dict)]
        except (ValueError, KeyError, TypeError):
            pass
        for x in complete_objects(text):
            try:
                out.append(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True))
            except ValueError:
                continue
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: good(x) if x else [])

    return run(column)
