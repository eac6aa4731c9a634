"""Quality rules with thresholds that follow the data.

Each document has fixed base rules and four measures: signs a word, repeated lines a line, words in repeated three-word
windows a word (each with one added above and below, so that a short document without any does not count as much as a
long one), and letters a word. For each language and source, a sketch of each measure counts the documents that pass the
base rules in buckets whose bounds grow by a constant factor; sketches merge by adding counts, and any quantile is
within that factor. A group's sketch is merged with that of its language at the weight of `PRIOR` documents, which
is merged with that of all in the same way: the more documents a group has, the more its own decide, without a switch.

A document passes if its measures are not above the group's upper quantile by more than `reach` times the distance
between that quantile and the lower one (letters a word: not below the lower one either). `MEASURES` has the quantiles and
reaches, which are the same for all groups; what is high for a group comes from its sketch alone. Up to a quarter of a
group may be junk that is full of signs or odd in its letters; for repeats, which clean texts have too, the upper
quantile is further out.

Edge cases: a null text has no words and fails the base rules, as an empty one does; null languages and sources are
groups of their own; repeated rows count each time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

BLANKS = " \t\n\x0b\x0c\r"
SIGNS = b"#*$%&|<>"
GROWTH = 1.02
#: Weight, in documents, at which a group's sketch is merged with that of its language, and a language's with that of all.
PRIOR = 50
UNIT = 1_000_000  # weights are whole millionths of a document
#: measure: lower and upper quantile in hundredths, reach, whether small values are suspect too
MEASURES = {"signs_a_word": (25, 75, 6.0, False), "repeated_lines": (50, 95, 2.0, False), "repeated_words": (50, 95, 8.0, False), "letters_a_word": (25, 75, 6.0, True)}

COUNTS = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64())])


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) < 2_000_000:
        windows = pairs[:-1] * len(known) + ids[2:]
    else:
        named = np.unique(pairs, return_inverse=True)[1]
        windows = named[:-1] * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(windows)] |= twice
    return int(hit.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """In the order of COUNTS; the last is the number of lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, len(raw) - len(raw.translate(None, SIGNS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and the measures."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *COUNTS])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [counts(t.as_py()) for t in part.column(3)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6))], schema=schema)

    ddl = "doc_id long, lang string, source string, " + ", ".join(f"{f.name} long" for f in COUNTS)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, ddl)
    smooth = lambda a, b: (F.col(a) + 1) / (F.col(b) + 1)
    return got.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        smooth("n_symbols", "n_words").alias("signs_a_word"),
        smooth("n_dup_lines", "n_lines").alias("repeated_lines"),
        smooth("n_repeat_words", "n_words").alias("repeated_words"),
        (F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words"))).alias("letters_a_word"),
    )


def bucket(value: Column) -> Column:
    """Values up to 1e-6 share the lowest bucket."""
    return F.ceil(F.log(F.greatest(value, F.lit(1e-6))) / math.log(GROWTH)).cast("int")


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, measure and bucket. Partial counts are summed before anything is shuffled."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES)))
    return rows.select(*keys, each.alias("x")).select(*keys, "x.*").groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def blended(own: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Sketches (keys, measure, bucket, n) merged with `PRIOR` documents' worth of those of their parents; n in units."""
    whole = F.sum("n").over(W.partitionBy(*parent_keys, "measure"))
    lent = F.floor(F.lit(float(PRIOR * UNIT)) * (F.col("n").cast("double") / whole.cast("double"))).cast("long")
    share = parent.select(*(F.col(k).alias(f"of_{k}") for k in parent_keys), F.col("measure").alias("of_measure"), "bucket", lent.alias("n"))
    same = F.col("measure") == F.col("of_measure")
    for k in parent_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    got = own.select(*keys, "measure").distinct().join(share, same).select(*keys, "measure", "bucket", "n")
    return merged(own.select(*keys, "measure", "bucket", (F.col("n") * UNIT).alias("n")).unionAll(got), keys)


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each group and measure the lowest and highest value that passes."""
    group = W.partitionBy(*keys, "measure")
    ranked = sketch.select("*", F.sum("n").over(group.orderBy("bucket")).alias("up_to"), F.sum("n").over(group).alias("size"))
    value = F.pow(F.lit(GROWTH), F.col("bucket"))
    wanted = lambda k: F.create_map(*(F.lit(x) for m, rule in MEASURES.items() for x in (m, rule[k])))[F.col("measure")]
    q = lambda k: F.min(F.when(100 * F.col("up_to") >= wanted(k) * F.col("size"), value))
    by = ranked.groupBy(*keys, "measure").agg(q(0).alias("a"), q(1).alias("b"))
    by = by.select(*keys, "measure", (F.col("b") + wanted(2) * (F.col("b") - F.col("a"))).alias("high"), (F.col("a") - wanted(2) * (F.col("b") - F.col("a"))).alias("low"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    out = [pick(m, "high").alias(f"high_{m}") for m in MEASURES] + [pick(m, "low").alias(f"low_{m}") for m, rule in MEASURES.items() if rule[3]]
    return by.groupBy(*keys).agg(F.struct(*out).alias("fence"))


def group_fences(passed: DataFrame, folder: str) -> DataFrame:
    """lang, source and the fences of each group, from the measures of the documents that pass the base rules."""
    own = shared.written(sketches(passed, ["lang", "source"]), folder, "sketches")
    lang = merged(own, ["lang"])
    by_lang = shared.written(blended(lang, ["lang"], merged(lang, []), []), folder, "languages")
    return fences(blended(own, ["lang", "source"], by_lang, ["lang"]), ["lang", "source"])


def judged(docs: DataFrame, folder: str) -> DataFrame:
    """All documents with their counts, base_failed and kept."""
    rows = shared.written(measured(docs), folder, "measured")
    rule = shared.written(group_fences(rows.where(~F.col("base_failed")), folder), folder, "fences")
    rule = rule.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "fence")
    got = rows.join(rule, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    passes = F.lit(True)
    for m, (_, _, _, both) in MEASURES.items():
        passes = passes & (F.col(m) <= F.col(f"fence.high_{m}"))
        if both:
            passes = passes & (F.col(m) >= F.col(f"fence.low_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(passes, F.lit(False))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *MEASURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return judged(shared.documents(spark, sf_dir), shared.work_dir(spark, "quality")).drop(*MEASURES)


#: The same buckets, counted by grouping sets in place of merged sketches.
ORACLE = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, range(3) r(j) GROUP BY 1),
line AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS (SELECT doc_id, lang, source, base_failed, unnest([
        {'m': 'signs', 'x': (n_symbols + 1) / (n_words + 1), 'lo': 25, 'hi': 75, 'reach': 6.0::DOUBLE}, {'m': 'lines', 'x': (n_dup_lines + 1) / (n_lines + 1), 'lo': 50, 'hi': 95, 'reach': 2.0::DOUBLE},
        {'m': 'words', 'x': (n_repeat_words + 1) / (n_words + 1), 'lo': 50, 'hi': 95, 'reach': 8.0::DOUBLE}, {'m': 'letters', 'x': word_chars / greatest(1, n_words), 'lo': 25, 'hi': 75, 'reach': 6.0::DOUBLE}], recursive := TRUE) FROM base),
k AS (SELECT *, CAST(ceil(ln(greatest(x, 1e-6::DOUBLE)) / ln(1.02::DOUBLE)) AS INTEGER) AS b FROM v),
sketch AS (SELECT grouping(lang, source) AS g, lang, source, m, lo, hi, reach, b, count(*) AS n FROM k WHERE NOT base_failed
           GROUP BY GROUPING SETS ((lang, source, m, lo, hi, reach, b), (lang, m, lo, hi, reach, b), (m, lo, hi, reach, b))),
al AS (SELECT m, b, CAST(floor(50000000::DOUBLE * (n::DOUBLE / (sum(n) OVER (PARTITION BY m))::DOUBLE)) AS BIGINT) AS w FROM sketch WHERE g = 3),
la AS (SELECT lang, m, b, sum(w) AS w FROM (SELECT lang, m, b, n * 1000000 AS w FROM sketch WHERE g = 1 UNION ALL SELECT l.lang, m, al.b, al.w FROM (SELECT DISTINCT lang, m FROM sketch WHERE g = 1) l JOIN al USING (m)) GROUP BY ALL),
lw AS (SELECT lang, m, b, CAST(floor(50000000::DOUBLE * (w::DOUBLE / (sum(w) OVER (PARTITION BY lang, m))::DOUBLE)) AS BIGINT) AS w FROM la),
gr AS (SELECT lang, source, m, lo, hi, reach, b, sum(w) AS w FROM (SELECT lang, source, m, lo, hi, reach, b, n * 1000000 AS w FROM sketch WHERE g = 0
       UNION ALL SELECT s.lang, s.source, s.m, s.lo, s.hi, s.reach, lw.b, lw.w FROM (SELECT DISTINCT lang, source, m, lo, hi, reach FROM sketch WHERE g = 0) s JOIN lw ON lw.m = s.m AND lw.lang IS NOT DISTINCT FROM s.lang) GROUP BY ALL),
ranked AS (SELECT *, pow(1.02::DOUBLE, b) AS value, sum(w) OVER (PARTITION BY lang, source, m ORDER BY b) AS up_to, sum(w) OVER (PARTITION BY lang, source, m) AS size FROM gr),
q AS (SELECT lang, source, m, reach, min(value) FILTER (WHERE 100 * up_to >= lo * size) AS a, min(value) FILTER (WHERE 100 * up_to >= hi * size) AS z FROM ranked GROUP BY ALL),
fence AS (SELECT lang, source, m, z + reach * (z - a) AS high, CASE WHEN m = 'letters' THEN a - reach * (z - a) ELSE 0 END AS low FROM q),
verdict AS (SELECT doc_id, bool_and(coalesce(x <= high AND x >= low, FALSE)) AS good FROM k LEFT JOIN fence f ON f.m = k.m AND f.lang IS NOT DISTINCT FROM k.lang AND f.source IS NOT DISTINCT FROM k.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM base JOIN verdict USING (doc_id)
"""
