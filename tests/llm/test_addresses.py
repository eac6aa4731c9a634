"""Rows are found again though a later scan of the same files splits them otherwise, as it may with other executors."""

import contextlib

import pytest

from girder.llm import exact_dedup, language_id, minhash, shared

from .test_operators import folder, plain_components, prose

SPLITS = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionBytes": "1g"}


@contextlib.contextmanager
def other_splits(spark):
    """Until now each file is a partition of its own; from now on one partition has them all."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def scanned(spark, tmp_path):
    """12 texts; of each there is a copy and a near copy."""
    texts = [prose(100 + k, 150) for k in range(12)]
    rows = [(36 * (k % 3) + k, t) for k, t in enumerate([*texts, *texts, *(t + " more" for t in texts)])]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    shared.session_setup(spark)
    df = spark.read.parquet(f"{tmp_path}/d")
    places = shared.with_row_address(df.select("doc_id"))
    before = {r["doc_id"]: r["_row"] for r in places.collect()}
    with other_splits(spark):
        after = {r["doc_id"]: r["_row"] for r in shared.with_row_address(df.select("doc_id")).collect()}
    assert before != after  # else this tests nothing
    return df, rows


def test_exact_copies_go_by_one_address(spark, scanned):
    df, rows = scanned
    kept = exact_dedup.deduplicated(df, folder(spark))
    with other_splits(spark):
        got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    first = {}
    for doc_id, text in rows:
        first[text] = min(doc_id, first.get(text, doc_id))
    assert sorted(got) == sorted((d, t) for t, d in first.items())


def test_near_copies_go_by_one_address(spark, scanned):
    df, rows = scanned
    kept = minhash.deduplicated(df, folder(spark))
    with other_splits(spark):
        got = sorted(r["doc_id"] for r in kept.collect())
    assert got == sorted({c for _, _, c in plain_components(rows, 5, 80)})


def test_full_sets_are_those_of_the_signed_rows(spark, scanned, monkeypatch):
    df, rows = scanned
    proposed = minhash.proposed
    with contextlib.ExitStack() as later:

        def then_other_splits(members):
            later.enter_context(other_splits(spark))
            return proposed(members)

        monkeypatch.setattr(minhash, "proposed", then_other_splits)
        got = minhash.near_groups(df, folder(spark), 5).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 5, 80)


def test_known_language_joins_nothing(spark, tmp_path):
    rows = [(1, prose(k, 60), "en", k) for k in range(20)] + [(1, "12 34", "en", 20), (None, None, None, 21)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, _row long").write.parquet(f"{tmp_path}/d")
    got = language_id.known_language(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(r["_row"] for r in got.collect()) == list(range(20))
    assert "Join" not in got._jdf.queryExecution().toString()
