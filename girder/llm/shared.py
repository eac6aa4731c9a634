"""What the operators share: the cluster's shared folder, written tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch sent to a Python worker; texts may be long, so batches are short.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def session_setup(spark: SparkSession) -> None:
    """Short Arrow batches, so that a worker's memory holds few texts at a time.

    The queries and stages call this, as the setting is read when a plan runs, after they have returned; operators do
    not, and leave the session to their caller.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) under spark.checkpoint.dir, which every executor shares.

    Where the setting is empty (tests, a laptop) a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="girder-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it, for tasks that write files of their own."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterable of tuples, without holding all of them."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def addressed(df: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """`df` with an address for each row, and the name of the addresses' column, which `df` does not have itself.

    Addresses follow the splits of a scan, and these follow the executors at hand: a second scan of the same files may
    number its rows otherwise. So they are made once and written with the rows, and all that asks for rows by
    address reads the written table.
    """
    name = "_row"
    while name in df.columns:
        name = f"_{name}"
    return written(with_row_address(df, name), folder, "rows", compression="zstd"), name


def rows_kept(rows: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """Those of `rows` (`addressed`, under `name`) whose address is in `kept` (_row), without it."""
    return rows.join(kept.select(F.col("_row").alias(name)), name, "left_semi").drop(name)


def file_place(scan: DataFrame) -> Column:
    """File and place in it of each row of a scan of files: the same for each scan, however it is split."""
    try:
        place = scan.metadataColumn("_metadata")
        scan.select(place)
    except AnalysisException as e:
        raise ValueError("rows have a place in a file only in a scan of files") from e
    return F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))


def with_row_address(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number rows by scan partition and place. For rows that are scanned once: another scan may give other numbers."""
    return df.withColumn(name, F.monotonically_increasing_id())
