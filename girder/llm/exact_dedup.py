"""Exact duplicates by deterministic block naming.

A text without its ASCII white space is cut into blocks of a fixed size. The distinct blocks are sorted by their first
bytes and then by digest, over all partitions, and each gets an integer name by its place; then the names of adjacent blocks are paired, the
distinct pairs sorted and named in their turn, and so on until each document has one name. A block finds its name by its
digest; where two blocks share a digest, which is looked for, those that do find theirs by their bytes. So equal names
mean equal bytes, whatever the digest.

Edge cases: a null text is an empty one, and all empty texts are equal; of repeated rows of one doc_id one stays;
a null doc_id is larger than all others when rows tie; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BLOCK_BYTES = 1 << 10
#: Bytes of a block that it is sorted by before its digest.
HEAD_BYTES = 16
#: Stands beside the last block of an odd number; no name is as low.
ALONE = -(1 << 63)
#: Characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _named(distinct: DataFrame, keys: list[str], n: int, folder: str, name: str, *columns: Column) -> DataFrame:
    """Integer names in the order of the keys: sorted over all partitions, written once so that they stay."""
    ordered = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return shared.written(ordered.select(*columns, F.monotonically_increasing_id().alias("name")), folder, name)


def sha256(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def identities(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = sha256, *, address: str | None = None) -> DataFrame:
    """_row, doc_id, n_chars, text_sha256, n_blocks and name: two texts are equal if n_blocks and name are.

    `_row` is the column `address` of `docs`; without one, rows are numbered here, by the one scan that needs it.
    """
    spark = docs.sparkSession
    n = shared.partitions(spark)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    texts = docs.select(F.col(address).alias("_row"), *columns) if address else shared.with_row_address(docs.select(*columns))
    texts = texts.select("_row", "doc_id", F.length("text").alias("n_chars"), F.encode(without_blanks(F.col("text")), "UTF-8").alias("body"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("body") / block_bytes)).cast("int")
    block = lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))
    each = F.posexplode(F.transform(F.sequence(F.lit(0), n_blocks - 1), block)).alias("at", "block")
    cut = texts.select("_row", "doc_id", "n_chars", n_blocks.alias("n_blocks"), F.unhex(F.sha2("body", 256)).alias("whole"), each)
    whole = F.when(F.col("at") == 0, F.lower(F.hex("whole")))
    key = F.when(F.col("n_blocks") == 1, F.col("whole")).otherwise(digest(F.col("block"))) if digest is sha256 else digest(F.col("block"))
    at = shared.written(cut.select("_row", "doc_id", "n_chars", "n_blocks", "at", whole.alias("text_sha256"), key.alias("key")), folder, "blocks", compression="zstd")

    # one content for each digest goes over the network from each task, whatever the number of its copies
    contents = cut.select(key.alias("key"), "block").groupBy("key").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    # the driver samples what is sorted by, so that is short; blocks with a common beginning part by their digests
    names = _named(contents.withColumn("head", F.substring("lo", 1, HEAD_BYTES)), ["head", "key"], n, folder, "names-0", F.col("key"), (F.col("lo") != F.col("hi")).alias("twins"))
    columns = ["_row", "n_blocks", "at", "name"]
    level = at.join(names.where("not twins").select("key", "name"), "key").select(columns)
    twins = names.where("twins").select("key")
    if not twins.isEmpty():
        shared_digest = shared.written(cut.select("_row", "n_blocks", "at", "block", key.alias("key")).join(twins, "key", "left_semi"), folder, "twins")
        told = _named(shared_digest.select("block").distinct(), ["block"], n, folder, "twin-names", F.col("block"))
        level = level.unionAll(shared_digest.join(told, "block").select("_row", "n_blocks", "at", (-1 - F.col("name")).alias("name")))
    level = shared.written(level, folder, "level-0")
    done, k = level.where("n_blocks = 1").select("_row", "name"), 0
    todo = level.where("n_blocks > 1")
    blocks = at.agg(F.max("n_blocks")).first()[0] or 1
    while blocks > 1:
        k += 1
        blocks = (blocks + 1) // 2
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = todo.groupBy("_row", "n_blocks", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(ALONE)).alias("b"))
        pairs = shared.written(pairs, folder, f"pairs-{k}")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], n, folder, f"names-{k}", F.col("a"), F.col("b"))
        todo = shared.written(pairs.join(names, ["a", "b"]).select("_row", "n_blocks", "at", "name"), folder, f"level-{k}")
        left = F.ceil(F.col("n_blocks") / (1 << k))
        done = done.unionAll(todo.where((left == 1) & (F.ceil(F.col("n_blocks") / (1 << k - 1)) > 1)).select("_row", "name"))
        todo = todo.where(left > 1)
    return at.where("at = 0").select("_row", "doc_id", "n_chars", "n_blocks", "text_sha256").join(done, "_row")


def groups(docs: DataFrame, folder: str, address: str | None = None) -> DataFrame:
    """One row for each document: _row, doc_id, keep_id, group_size, kept, text_sha256."""
    named = shared.written(identities(docs, folder, address=address), folder, "identities")
    order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row"))
    best = named.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    got = named.join(best, ["n_blocks", "name"])
    return got.select("_row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best._row") == F.col("_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, folder: str) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows, name = shared.addressed(docs, folder)
    return shared.rows_kept(rows, name, groups(rows, folder, name).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(shared.documents(spark, sf_dir), shared.work_dir(spark, "exact-dedup")).drop("_row")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""
