"""Mixing sources to target weights: Pfair windows and an earliest-deadline-first interleaving. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise


def tempered_shares(docs: DataFrame, source: str = "source", power: float = 0.7, slots: int = 1000) -> DataFrame:
    """Rows (key, share): whole shares that sum to `slots`, in proportion to the sources' row counts to `power`, at least 1 each.

    Every source gets 1, the rest is dealt by largest remainder, ties to the lesser key. With many sources there are four slots for each, if that is more.
    """
    counts = docs.groupBy(source_key(source).alias("key")).count()
    total = Window.partitionBy()
    ideal = counts.withColumn("p", F.pow(F.col("count").cast("double"), F.lit(power))).withColumn("n", F.count("*").over(total))
    slots = F.greatest(F.lit(slots), 4 * F.col("n"))
    ideal = ideal.withColumn("ideal", F.col("p") / F.sum("p").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * (slots - F.col("n")))
    floors = ideal.withColumn("whole", F.floor(F.round("ideal", 9)))
    left = floors.withColumn("left", slots - F.col("n") - F.sum("whole").over(total))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("ideal") - F.col("whole"), 9).desc(), "key"))
    return left.select("key", (F.lit(1) + F.col("whole") + (rank <= F.col("left")).cast("long")).cast("long").alias("share"))


def source_key(source: str) -> Column:
    """A source's name as a key; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(f"`{source}`").cast("string")), F.lit("null"))


def pfair_pattern(shares: DataFrame) -> DataFrame:
    """Rows (key, share, slots, k, release, deadline, slot): the schedule of one period, which repeats unchanged.

    With weight w = share / slots, block k of a source may not run before floor(k / w) and must run before ceil((k + 1) / w). Slot by
    slot, the released block of the earliest deadline runs, ties to the lesser key; since the weights sum to 1 no deadline is
    missed, and a source is never a whole block ahead of or behind its weight. The schedule is one fold over the slots of a
    period, a parameter, or four for each source: its cost is slots times sources and does not depend on the rows.
    """
    one = shares.agg(F.array_sort(F.collect_list(F.struct("key", "share"))).alias("s"), F.sum("share").alias("slots"))
    fold = """
      aggregate(sequence(0L, slots - 1),
        named_struct('done', transform(s, x -> 0L), 'picked', CAST(array() AS array<int>)),
        (acc, t) -> aggregate(array(array_min(filter(transform(s, (x, i) -> named_struct(
              'open', acc.done[i] < x.share AND floor(acc.done[i] * slots / x.share) <= t,
              'deadline', CAST(ceil((acc.done[i] + 1) * slots / x.share) AS bigint), 'i', i)), c -> c.open))), acc,
          (a, c) -> named_struct(
            'done', transform(a.done, (d, i) -> CASE WHEN i = c.i THEN d + 1 ELSE d END),
            'picked', concat(a.picked, array(c.i)))),
        acc -> acc.picked)"""
    picked = one.filter("slots > 0").select("s", "slots", F.posexplode(F.expr(fold)).alias("slot", "i"))
    of = picked.select(F.expr("s[i].key").alias("key"), F.expr("s[i].share").alias("share"), "slots", "slot")
    k = F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1
    out = of.withColumn("k", k.cast("long"))
    return out.select("key", "share", "slots", "k", F.floor(F.col("k") * F.col("slots") / F.col("share")).alias("release"), F.ceil((F.col("k") + 1) * F.col("slots") / F.col("share")).alias("deadline"), F.col("slot").cast("long").alias("slot"))


def mix_sources(docs: DataFrame, shares: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", block: int = 8, slots: int = 1000, power: float = 0.7, chunks: int = 256) -> DataFrame:
    """Rows (doc_id, source, block, release, deadline, slot, place): the whole table as an interleaving of blocks of its sources.

    Documents of a source stand in the order of md5(id) and form blocks of `block`; a block is scheduled in its slot by
    `pfair_pattern` (release and deadline in slots from the start); read by (slot, place) the sources follow their shares. A
    source that ends early leaves its later slots empty, so the others keep their proportions; no row is dropped or repeated.

    `shares` has (key, share) as `tempered_shares` gives (the default); sources without a share are an error. A null source is one
    source; null ids come first in it; rows that repeat an id share its place in the order, each with a place of its own. Other
    columns are ignored and texts not read; an empty table gives an empty result.

    A hot source is ranked in `chunks` ranges of the digest: a row's rank is that within (source, chunk) plus the sizes of the chunks
    before, from one small grouped count.
    """
    shares = shares if shares is not None else tempered_shares(docs, source, power, slots)
    pattern = materialise(pfair_pattern(shares), "mix-pattern")
    digest = F.coalesce(F.md5(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), source_key(source).alias("key"), digest.alias("digest"))
    rows = rows.withColumn("chunk", F.floor(F.coalesce(F.conv(F.substring("digest", 1, 6), 16, 10).cast("double"), F.lit(0.0)) * chunks / (1 << 24)).cast("int"))
    sizes = rows.groupBy("key", "chunk").count()
    before = sizes.select("key", "chunk", (F.sum("count").over(Window.partitionBy("key").orderBy("chunk")) - F.col("count")).alias("before"))
    within = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("digest")))
    placed = within.join(before, ["key", "chunk"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    blocks = placed.select("doc_id", "source", "key", F.floor(F.col("rank") / block).alias("block"), F.pmod("rank", F.lit(block)).alias("place"))
    period = blocks.join(pattern.select("key", "share", "slots").distinct(), "key", "left")
    period = period.withColumn("k", F.pmod("block", F.coalesce("share", F.raise_error(F.lit("a source has no share")).cast("long"))))
    # the pattern has `slots` rows, or four a source: no hint, so that Spark broadcasts it by the size of its files
    slotted = period.drop("share", "slots").join(pattern, ["key", "k"])
    turn = F.floor(F.col("block") / F.col("share")) * F.col("slots")
    return slotted.select("doc_id", "source", "block", *[(turn + F.col(c)).alias(c) for c in ("release", "deadline", "slot")], F.col("place").cast("long").alias("place"))
