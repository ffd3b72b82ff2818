"""Line dedup: overlapping windows of consecutive lines that occur earlier in the corpus are removed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _digest(*parts: Column) -> list[Column]:
    """128 bits: two hashes that start from different values."""
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")]


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, kept): each text without the lines of repeated windows, one row per input row.

    Lines end at \\n and are compared without spaces at their ends. A window is `window` consecutive lines; of the places where a
    window stands, the first by (doc_id, text digest, line) stays and the lines of every other are removed, overlaps merged. A
    text of fewer lines has no window and stays whole, and so does an empty one (one empty line); a null text has no lines and
    kept is null. A null doc_id comes first. Rows that repeat an id and its text are one place, and are treated alike. Other
    columns are ignored; an empty table gives an empty result.

    Windows travel as 128-bit hashes. First places are a grouped minimum (combined before the shuffle), the removed lines of a
    document the bits of one array; only the last join, on the document, moves texts.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = source.withColumn("digest", F.xxhash64("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(F.trim(x)))
    second = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(F.lit(1), F.trim(x)))
    hashed = keyed.select("doc_id", "digest", lines.alias("a"), second.alias("b")).filter(F.size("a") >= window)
    placed = hashed.select("doc_id", "digest", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("a") - (window - 1)), lambda i: F.struct(
        F.xxhash64(*[F.get("a", i + (k - 1)) for k in range(window)]).alias("h1"), F.xxhash64(*[F.get("b", i + (k - 1)) for k in range(window)]).alias("h2")))).alias("line", "h"))
    windows = materialise(placed.select("doc_id", "digest", "line", "h.h1", "h.h2"), "line-windows")
    place = F.struct("doc_id", "digest", "line")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    later = windows.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    removed = later.select("doc_id", "digest", F.explode(F.array(*[F.col("line") + k for k in range(window)])).alias("line"))
    # line numbers as bits of 64-bit words, so that a line is looked up at once
    words = removed.groupBy("doc_id", "digest", F.floor(F.col("line") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, line % 64))").alias("bits"))
    removed = words.groupBy("doc_id", "digest").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("most"), F.sum(F.bit_count("bits")).alias("n"))
    removed = removed.select("doc_id", "digest", "n", F.transform(F.sequence(F.lit(0), "most"), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("removed"))
    both = keyed.alias("d").join(removed.alias("r"), F.expr("d.doc_id <=> r.doc_id AND d.digest = r.digest"), "left").select("d.doc_id", "d.text", F.split("d.text", "\n", -1).alias("lines"), "r.removed", "r.n")
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.expr("filter(lines, (x, i) -> coalesce(shiftright(get(removed, CAST(i DIV 64 AS INT)), i % 64), 0L) % 2 = 0)"), "\n"))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    return both.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
