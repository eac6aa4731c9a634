"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.

Edge cases are those of the operators: null and empty texts go in the first stage, as they have no language; repeated rows
lose all but one in the second; an empty table gives an empty result; further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girder.llm import exact_dedup, language_id, minhash, packing, pii, shared, tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go."""
    shared.session_setup(spark)
    return language_id.known_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    return exact_dedup.deduplicated(docs, shared.work_dir(spark, "pipeline-exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one stays."""
    shared.session_setup(spark)
    return minhash.deduplicated(docs, shared.work_dir(spark, "pipeline-near"), width=5)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    shared.session_setup(spark)
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    shared.session_setup(spark)
    return packing.pack(docs, tokens.default_path(), shared.work_dir(spark, "pipeline-packing"), forget=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: The classifier, the random field and packing have no SQL form; tests/llm hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next reads it."""
    docs = shared.documents(spark, sf_dir)
    folder = shared.work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), folder, name)
    return docs
