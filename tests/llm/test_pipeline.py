"""The pipeline on small corpora, stage by stage and as a whole."""

import re
import zlib

import numpy as np

import corpus_pipeline
from girder.llm import pii, shared

from .test_operators import GERMAN, PLAIN, plain_components, plain_ids, prose


def test_stages(spark, tmp_path):
    base = prose(1, 200)
    texts = [None, "", "12 34", base, base.replace(" ", "  "), base + " more", prose(2, 200), prose(3, 200, GERMAN), prose(4, 80) + " write to a.b@c.de now", prose(2, 200)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = shared.documents(spark, str(tmp_path)), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, str(tmp_path)), shared.work_dir(spark, "stages"), name)
        left[name] = {r["doc_id"] for r in docs.collect()}
        if name == "pii":
            assert next(r["text"] for r in docs.collect() if r["doc_id"] == 8).endswith("write to <EMAIL> now")
    assert left["language_id"] == set(range(3, 10))
    assert left["exact_dedup"] == {4, 5, 6, 7, 8}  # the longest of equal texts, then the first
    assert len(left["near_dedup"] & {4, 5}) == 1 and {6, 7, 8} <= left["near_dedup"]
    assert left["packing"] == left["pii"] == left["near_dedup"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == left["packing"]


def test_all_stages_against_plain_ones(spark, tmp_path):
    """run() on some hundred texts with copies, near copies and personal data; what is left, and each piece's ids."""
    rng, texts = np.random.default_rng(12), [None, "", "3 4", "--"]
    for k in range(60):
        words = prose(500 + k, int(rng.integers(3, 160)), GERMAN if k % 3 == 0 else ["the", "of", *(f"word{j}" for j in range(300))]).split()
        for _ in range(int(rng.integers(1, 4))):
            texts.append(" ".join(words) if rng.random() < 0.5 else "\n ".join(words))
            if rng.random() < 0.4:
                texts.append(" ".join(words[:-1] + ["other"]))
        if k % 5 == 0:
            texts.append(" ".join(words) + f" mail a{k}@b.example or +1 (234) 555-{1000 + k} from 10.0.0.{k}, card 4111111111111111")
    rows = [(int(i), t, "de" if t and " der " in t else "en", "s", len(t or "")) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    left = [(i, t) for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    equal = {}
    for i, t in left:
        equal.setdefault(re.sub(r"\s", "", t), []).append((-len(t), i, t))
    left = sorted(min(some)[1:] for some in equal.values())
    left = [(i, t) for (i, t), (d, _, c) in zip(left, plain_components(left, 5, 80), strict=True) if d == c]
    want = {}
    for i, t in left:
        spans = sorted((m.start(), m.end(), k.upper()) for k, (p, good) in PLAIN.items() for m in re.finditer(p, t) if good(m.group()))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert pii.all_spans([t], pii.field())[0][0] == pii.all_spans([t], pii.field())[0][1]  # the field adds nothing here
        for a, b, kind in reversed(spans):
            t = f"{t[:a]}<{kind}>{t[b:]}"
        want[i] = plain_ids(t)

    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for start, n, crc, total in sorted(pieces[i]):
            assert (start, total, crc) == (at, len(ids) // 4, zlib.crc32(ids[4 * at : 4 * (at + n)]))
            at += n
        assert at == len(ids) // 4
    for some in sequences.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_the_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11))
