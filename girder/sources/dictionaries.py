"""Dictionaries and recognised tables from files: JSON, XML, attribute markup, model answers, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.operators.ordered import up_to

THRESHOLDS = "base double, a double, b double, thickness double"
CATALOG = "id string, shape string, label string, dims map<string,double>, standard string, standardStatus string, source string, areaMm2 double, massPerMeter double"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON array, under a fixed schema; what does not fit is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def lenient_number(text: Column) -> Column:
    """0 for what is no number."""
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def xml_thresholds(spark: SparkSession, path: str, row_tag: str = "row", cell: str = "cell") -> DataFrame:
    """Rows of four cells or more; shorter ones are skipped."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"{cell} array<string>").load(path)
    names = ("base", "a", "b", "thickness")
    return rows.where(F.size(cell) >= 4).select(*(lenient_number(F.get(cell, F.lit(k))).alias(n) for k, n in enumerate(names)))


def xml_coats(spark: SparkSession, path: str) -> DataFrame:
    """Nested coats -> limits -> rows, flattened; a limit without rows keeps one with nulls."""
    point = "struct<_dpr: double, _delta: double, _rate: double>"
    schema = f"_index int, column array<struct<_min: double, heat: {point}, row: array<{point}>>>"
    coats = spark.read.format("xml").option("rowTag", "coat").schema(schema).load(path)
    limits = coats.select(F.col("_index").alias("coat"), F.posexplode_outer("column").alias("c_ord", "c"))
    rows = limits.select("coat", "c_ord", F.col("c._min").alias("limit"), F.col("c.heat._rate").alias("heat_rate"), F.posexplode_outer("c.row").alias("ord", "r"))
    return rows.select("coat", "c_ord", "limit", "heat_rate", "ord", F.col("r._dpr").alias("dpr"), F.col("r._delta").alias("delta"), F.col("r._rate").alias("rate"))


TAG = r"<(select|o)\b([^>]*)>"
ATTRIBUTE = r"([\w-]+)\s*=\s*\"([^\"]*)\""


def markup_catalog(spark: SparkSession, path: str) -> DataFrame:
    """`<select shape=..>` sets the shape of the `<o ..>` items behind it; attributes that are no numbers are not dimensions."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    tags = text.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(TAG), F.lit(0))).alias("ord", "tag"))
    pairs = F.arrays_zip(F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
    bag = F.map_from_entries(F.array_distinct(pairs))
    rows = tags.withColumn("bag", bag).withColumn("shape", F.last(F.when(F.col("tag").startswith("<select"), F.col("bag")["shape"]), ignorenulls=True).over(up_to(["file"], ["ord"])))
    numbers = F.map_filter(F.transform_values("bag", lambda k, v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double")), lambda k, v: v.isNotNull() & (k != "id"))
    return rows.where(F.col("tag").startswith("<o")).select("shape", F.col("bag")["id"].alias("id"), F.col("bag")["label"].alias("label"), numbers.alias("dims"), "file", "ord")


def columns_and_rows(df: DataFrame, columns: str, rows: str, mass: str, computed: Column) -> DataFrame:
    """A catalog that lists its columns once and then arrays of values; a missing mass is computed."""
    each = df.select("*", F.posexplode(rows).alias("ord", "_row")).withColumn("bag", F.map_from_arrays(columns, "_row"))
    return each.withColumn("mass", F.coalesce(F.col("bag")[mass].try_cast("double"), computed)).drop(columns, rows, "_row")


def catalog_tree(df: DataFrame) -> DataFrame:
    """shape -> standards -> families -> profiles, to one row for each profile."""
    one = df.select("shape", F.explode("standards").alias("s"))
    two = one.select("shape", F.col("s.name").alias("standard"), F.col("s.status").alias("status"), F.explode("s.families").alias("f"))
    return two.select("shape", "standard", "status", F.col("f.name").alias("family"), F.explode("f.profiles").alias("p")).select("shape", "standard", "status", "family", "p.*")


def answer_json(text: Column) -> Column:
    """A model's answer without its code fence: from the first brace to the last."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


ROWS = "struct<rows: array<struct<name: string, profile: string, mass: double, parts: array<struct<kind: string, mass: double>>>>>"


def answer_rows(df: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of an answer, in order; an answer that cannot be read gives none."""
    got = df.select(key, F.from_json(answer_json(F.col(text)), ROWS).alias("j"))
    return got.select(key, F.posexplode("j.rows").alias("ord", "r")).select(key, "ord", "r.*")


def with_ids(df: DataFrame, by: str, order: list[str], start: int = 1) -> DataFrame:
    """Ids in input order, within each document."""
    return df.withColumn("id", (F.row_number().over(W.partitionBy(by).orderBy(*order)) + (start - 1)).cast("bigint"))
