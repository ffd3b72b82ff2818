"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting by which Spark removes a query's shuffle files as the query ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A local session may do without and gets one in the working folder; a cluster may not."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = path or f"{os.path.abspath('spark-warehouse')}/scratch"
    return path.rstrip("/") if "://" in path else f"file://{path.rstrip('/')}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. Shuffle files of the write go with it, not when the driver happens to collect its garbage."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised frame that nothing needs any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def mark_maybe(df: DataFrame, key: Column, keys: DataFrame, least_bits: int = 16, most: int = 1 << 28) -> DataFrame:
    """Adds `maybe` to df: true wherever key (a 64-bit hash) is in the one column of `keys`, and by chance for at most 1 of `least_bits` others.

    A bitmap of `least_bits` to twice as many bits a key, `most` at most (32 MB; with more keys the share by chance grows, no key is missed), is broadcast in pieces of 4 KB. So what cannot match stays in place,
    and a join that decides has few rows to move, however large the keys have become.
    """
    bits = 1 << max(15, min(most.bit_length() - 1, (least_bits * keys.count()).bit_length()))

    def place(hashed: Column) -> tuple[Column, Column]:
        at = hashed.bitwiseAND(bits - 1)
        return F.shiftright(at, 15).alias("_piece"), at.bitwiseAND((1 << 15) - 1).alias("_bit")

    placed = keys.select(*place(F.col(f"`{keys.columns[0]}`"))).repartition("_piece")
    bitmap = materialise(placed.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmap")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_bit DIV 8 AS int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftleft(1, CAST(_bit % 8 AS int))").bitwiseAND(byte) != 0, F.lit(False))
    return df.select("*", *place(key)).join(F.broadcast(bitmap), "_piece", "left").select(*[F.col(f"`{c}`") for c in df.columns], maybe.alias("maybe"))


def bound_batches(df: DataFrame, max_bytes: int = 4 << 20) -> None:
    """Texts reach the workers in batches of bytes, not of rows only, so that neither side holds many at a time; a longer text stands alone."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", max_bytes)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = -1, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about max_bytes of text; a longer text stands alone, never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def whole_rows(df: DataFrame, text: str) -> DataFrame:
    """Two columns: `row`, all of df's columns as a struct (so that no name can clash), and `text`."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows (node, component) for every node of `edges` (columns a, b of one integer type); component is the least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each step is a grouped minimum and a join, the number of
    edges never grows, and each round is written to the shared folder in place of the one before. An empty edge table gives an empty result.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        last, edges = edges, materialise(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
