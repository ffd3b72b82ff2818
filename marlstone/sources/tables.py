"""Scans and sinks: exports in several dialects, nested JSON, binary assets, whole texts; split, hashed and idempotent writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as X
from ..operators import quality
from .shared import discard, materialise, scratch, shared_dir  # noqa: F401


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options: object) -> DataFrame:
    """CSV with a header and a given schema (no second scan to infer one); empty fields are null."""
    return spark.read.schema(schema).options(header=True, nullValue="", **options).csv(path)


def read_exports(spark: SparkSession, path: str, columns: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """All text columns of the CSV files in a folder, with source_file and source_row (the first row of data is 2).

    A file's rows are numbered by their place in the file, which holds while a file is read in one piece, as with
    multiLine (fields may hold line ends, so a file cannot be split); numbers come from one scan, which is written.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).options(header=True, multiLine=True, pathGlobFilter=pattern).csv(path)
    placed = materialise(rows.select("*", F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("_at")), "exports")
    first = placed.groupBy("source_file").agg(F.min("_at").alias("_first"))
    return placed.join(first, "source_file").withColumn("source_row", F.col("_at") - F.col("_first") + 2).drop("_at", "_first")


def malformed_rows(spark: SparkSession, path: str, fields: int, separator: str = ",") -> DataFrame:
    """Rows (source_file, malformed): lines without quotes that do not have `fields` fields."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    wrong = F.size(F.split("value", separator, -1)) != fields
    return lines.groupBy("source_file").agg(F.count_if(wrong).alias("malformed"))


def read_feature_collection(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features of a GeoJSON collection as rows: x, y and the properties named in a DDL text."""
    schema = f"features array<struct<geometry struct<type string, coordinates array<double>>, properties struct<{properties}>>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return one.select(F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), "f.properties.*")


def to_features(df: DataFrame, x: str, y: str) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    rest = F.struct(*[c for c in df.columns if c not in (x, y)])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), rest.alias("properties"))).alias("value"))


def binary_assets(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> DataFrame:
    """Rows (path, size_bytes, sha256) of all files below path but those with a suffix in skip. A file is read whole (below 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if skip:
        files = files.filter(~F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).isin(*skip))
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), X.clean_text(F.col("value")).alias("text"))


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, reason: str = "quarantine_reason") -> None:
    """Accepted and quarantined rows in one pass, in folders by status."""
    df.withColumn("status", F.when(F.col(reason).isNull(), "accepted").otherwise("quarantined")).write.mode("overwrite").partitionBy("status").parquet(path)


def write_hashed(df: DataFrame, path: str, key: str, n: int) -> None:
    """n folders by a hash of the key, each from a task of its own, so it gets one file. A task keeps a writer for each folder it meets, so that nothing is sorted by folder first."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, n)
    try:
        df.withColumn("bucket", X.md5_bucket(F.col(key), n)).repartitionById(n, F.coalesce("bucket", F.lit(0)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)
    finally:
        conf.set(name, before)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> str:
    """Write the upserted table beside the old one, which stays; returns the new version's path."""
    old = spark.read.parquet(path)
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    quality.latest_wins(old, new.select(old.columns), keys).write.parquet(target)
    return target


def append_unseen(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Append rows of keys that the table does not hold yet; doing it again changes nothing."""
    old = spark.read.parquet(path)
    fresh = materialise(quality.insert_ignore(old, new.select(old.columns), keys), "fresh")
    fresh.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
