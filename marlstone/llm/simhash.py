"""SimHash near-duplicate groups: fingerprints of word shingles, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, connected_components, discard, mark_maybe, materialise, text_slices

SEED = 42
#: The bits of each byte value, most significant first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LANES = 256 * np.arange(8)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it is shorter; none for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_of(joined, SEED)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(joined)]
    return np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts, ends, strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where over half of the hashes have them set; 0 without hashes."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    # a histogram of byte values for each of the eight bytes, instead of 64 sums of bits
    lanes = np.bincount((hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + LANES).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((lanes @ BITS).ravel() * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, key, fp): a hash of the text and its 64-bit fingerprint as a signed long. One row per input row, in place (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            values = [fingerprint(t, shingle) for t in as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], ["doc_id", "key", "fp"])

    whole = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("key"), whole.alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def masks(radius: int, blocks: int) -> list[int]:
    """Signed 64-bit masks of all choices of blocks - radius blocks: fingerprints within the radius agree under at least one."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    chosen = (sum(block[i] for i in keep) for keep in combinations(range(blocks), blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def close_pairs(fps: DataFrame, radius: int = 2, blocks: int = 4, max_block: int = 64) -> DataFrame:
    """Rows (a, b) that link distinct fingerprints (column fp) as all pairs within `radius` bits would; radius is even.

    Pigeonhole: with the fingerprint in `blocks` blocks, a close pair agrees on at least blocks - radius of them, so each choice of
    that many blocks is a join key, and the Hamming distance is checked. A key under which more than max_block fingerprints meet
    is not joined with itself: its fingerprints go to their balls of radius / 2 instead, a pair is close exactly if its balls
    meet, and the members of a meeting point are linked to the least of them. So no group makes all its pairs, and no link is lost.
    """
    if radius % 2 or radius >= blocks:
        raise ValueError("radius must be even and below the number of blocks")
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius, blocks))])).alias("key")).select("fp", "key.i", "key.k")
    sizes = keys.groupBy("i", "k").count().filter("count > 1")
    shared = materialise(keys.join(sizes, ["i", "k"]), "simhash-blocks")
    cold = shared.filter(F.col("count") <= max_block).select("i", "k", "fp")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = cold.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), ["i", "k"]).filter((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b")
    hot = shared.filter(F.col("count") > max_block).select("fp").distinct()
    flips = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    ball = F.explode(F.transform(F.array(*[F.lit(f - (1 << 64) if f >> 63 else f) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f)))
    balls = hot.select("fp", ball.alias("point"))
    centre = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = balls.join(centre, "point").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, blocks: int | None = None, max_block: int = 64) -> DataFrame:
    """Rows (doc_id, key, fp, component_id, component_key), one per input row; component_id is the least doc_id linked, directly or by way of others.
    The keys are hashes of the texts; component_key is that of the row of component_id (the lesser, if texts share the id).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle. Null,
    empty and blank texts have fingerprint 0 and are linked with each other. Repeated rows keep a row each. A null doc_id
    takes part but is never a component_id while the component has another. Other columns are ignored; an empty table gives none.
    Texts are not shuffled: only (doc_id, fingerprint) is written, and links are between distinct fingerprints. The number of
    blocks, unless given, is the least whose keys have two bits more than it takes to count the distinct fingerprints.
    """
    bound_batches(docs)
    found = materialise(fingerprints(docs, doc_id, text, shingle), "simhash")
    fps = materialise(found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")), "simhash-distinct")
    n = fps.count()
    blocks = blocks or next(b for b in range(radius + 1, 65) if 64 * (b - radius) / b >= math.log2(max(1, n)) + 2 or b == 64)
    groups = connected_components(close_pairs(fps.select("fp").repartition(max(1, n // 20_000)), radius, blocks, max_block))
    member = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # only linked fingerprints need a second look; the others are their own component
    linked = member.join(groups.select("component").distinct(), "component", "left_semi")
    label = linked.groupBy("component").agg(F.min("least").alias("first"))
    of = member.join(label, "component", "left").select("fp", F.coalesce("first", "least").alias("first"))
    return found.join(of, "fp").select("doc_id", "key", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("component_key"))


CLASSES = 32  # of a document's shingle classes, those that make up its blocks
SHORT = 256  # shingles up to which a set has a block for each shingle of its prefix
SKETCH = 256  # least shingle hashes kept, to discard pairs far below the similarity before whole sets are fetched
COMMON_BITS = 24  # of a hash, those that find it in the bitmap of common shingles: 2 MB at any size of the corpus
COMMON = 1 << 20  # shingles at most that enter the bitmap, those of the highest counts
CHUNK = 1 << 18  # shingles, and EACH a document besides, of a chunk of a hot block: bounds what one comparison of two chunks holds
EACH = 128


def _levels(n: int, similarity: float) -> set[int]:
    """Class numbers, as powers of two, that leave two to four shingles a class; two of them if a similar set could have the next."""
    return {max(0, math.floor(math.log2(k / 2))) for k in (n, n / similarity)}


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of n sorted hashes, those that the bitmap `common` marks last."""
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    if common is None:
        return hashes[:size]
    at = hashes & np.uint64((1 << COMMON_BITS) - 1)
    marked = (common[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return np.concatenate([hashes[~marked], hashes[marked]])[:size]


def common_shingles(docs: DataFrame, text: str, shingle: int, similarity: float, least: int = 4, most: int = COMMON) -> np.ndarray:
    """A bitmap, by the last COMMON_BITS bits of the hash, of the shingles that at least `least` documents of up to SHORT shingles have in their prefixes.

    A passage that many texts hold is put behind what is rare in them, so that texts meet by what few share. Any bitmap gives one order for all texts, and
    prefixes are exact in any order: other shingles that fall on a marked bit, or marks left out since more than `most` are as common, cost time, not links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in as_bytes(part.column(0))]
            firsts = [prefix(s, similarity) for s in sets if 0 < len(s) <= SHORT]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64))], ["hash"])

    hashes = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "hash long")
    counts = materialise(hashes.groupBy("hash").count().filter(F.col("count") >= least), "similar-common")
    # whole powers of two of the count, from the highest down, while they fit
    level, room = None, most
    for row in counts.groupBy(F.floor(F.log2("count")).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if row.n > room:
            break
        level, room = row.level, room - row.n
    bitmap = np.zeros(1 << (COMMON_BITS - 3), np.uint8)
    if level is not None:
        bit = F.col("hash").bitwiseAND((1 << COMMON_BITS) - 1)
        words = counts.filter(F.col("count") >= 1 << level).groupBy(F.shiftright(bit, 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, CAST(hash & 7 AS int))")).alias("bits"))
        found = words.toPandas()
        bitmap[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    discard(counts)
    return bitmap


def class_blocks(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None) -> list[int]:
    """Blocks of a set of shingle hashes: for each of CLASSES classes of the hash that has any, a hash of the class's members.

    Pigeonhole over the set: a pair of the given similarity differs in few shingles, these fall into few of the many small classes, and any
    class without a difference is a block that the pair shares. Sets of up to SHORT shingles meet by prefixes instead, which is exact: of two
    similar sets in one order, some shingle is among the first n - ceil(similarity n) + 1 of each; the order is that of the hash, common shingles last. A set that may meet both kinds has both blocks.
    """
    out: list[int] = []
    n = len(hashes)
    if n <= SHORT:
        out += prefix(np.sort(hashes), similarity, common).view(np.int64).tolist()
    for level in _levels(max(n, SHORT + 1), similarity) if n / similarity > SHORT else ():
        of = hashes & np.uint64((1 << level) - 1)
        mine = of < CLASSES
        if mine.any():
            order = np.argsort(of[mine], kind="stable")
            members, classes = hashes[mine][order], of[mine][order]
            first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
            sums = np.add.reduceat((members ^ (members >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15), first)
            out += (sums ^ ((classes[first] + np.uint64(64 * level)) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64).tolist()
    return out


def set_hash(distinct: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingle hashes; 0 for none."""
    return int((((distinct ^ (distinct >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)).view(np.int64)) if len(distinct) else 0


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """Rows (doc_id, key, fp, whole, n, blocks, sketch): a hash of the text, the fingerprint, a hash and the size of the shingle set, its blocks and its least hashes (leading 32 bits)."""
    marks = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = []
            for t in as_bytes(part.column(2)):
                hashes = shingle_hashes(t, shingle)
                distinct = np.unique(hashes)
                rows.append((majority(hashes), set_hash(distinct), len(distinct), class_blocks(distinct, similarity, marks.value) if len(distinct) else [], (distinct[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes()))
            fps, wholes, sizes, blocks, sketches = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(wholes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "key", "fp", "whole", "n", "blocks", "sketch"])

    whole_text = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole_text).alias("key"), whole_text.alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, key long, fp long, whole long, n long, blocks array<long>, sketch binary")


def sketch_similarity(pairs: DataFrame) -> DataFrame:
    """Adds similarity, the estimated share of common shingles, to pairs with sketches a_sketch and b_sketch."""
    names = [c for c in pairs.columns if not c.endswith("_sketch")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), strict=True):
                x, y = np.unique(np.frombuffer(a, np.uint32)), np.unique(np.frombuffer(b, np.uint32))
                union = np.union1d(x, y)[: SKETCH if max(len(a), len(b)) == 4 * SKETCH else None]
                found.append(float(np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean()) if len(union) else 1.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found)], [*names, "similarity"])

    return pairs.mapInArrow(run, ", ".join(f"{n} {pairs.schema[n].dataType.simpleString()}" for n in names) + ", similarity double")


def shingle_sets(docs: DataFrame, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """Rows (id, shingles): the whole shingle set, as sorted 64-bit hashes, of each node of `wanted` (columns id and key, the hash of one of its texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in as_bytes(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["whole", "n", "shingles"])

    source = docs.select(F.col(f"`{text}`").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    # texts stay in place; what the marks let through by chance goes where ids are joined
    again = mark_maybe(source, F.col("key"), wanted.select("key")).filter("maybe").select("text").mapInArrow(run, "whole long, n long, shingles binary")
    return again.select(F.xxhash64("whole", "n").alias("id"), "shingles").groupBy("id").agg(F.first("shingles").alias("shingles")).join(wanted.select("id"), "id", "left_semi")


def whole_similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (a, b, similarity) of pairs (a, b): the share of common shingles, from whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                found.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set")), "b")
    return both.mapInArrow(run, "a long, b long, similarity double")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The number of common members of each set of left and each of right, by products of slabs of the members that both sides have."""
    (x, y), out = [np.concatenate(s) for s in (left, right)], np.zeros((len(left), len(right)), np.float64)
    both = np.intersect1d(x, y)
    for start in range(0, len(both), width):
        slab, marks = both[start : start + width], []
        for sets, keys in ((left, x), (right, y)):
            at = np.minimum(np.searchsorted(slab, keys), len(slab) - 1)
            mark = np.zeros((len(sets), len(slab)), np.float32)
            mine = slab[at] == keys
            mark[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[mine], at[mine]] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix connects, one fewer than the members of each component."""
    left, out = np.ones(len(near), dtype=bool), []
    for i in range(len(near)):
        stack = [i] if left[i] else []
        left[i] = False
        while stack:
            u = stack.pop()
            new = np.flatnonzero(near[u] & left).tolist()
            left[new] = False
            out += [(u, v) for v in new]
            stack += new
    return out


def hot_links(hot: DataFrame, stars: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Rows (a, b): with `links`, what connects the members of hot blocks (rows centre, id, n) as all their similar pairs would.

    Blocks of one centre are one group, since copies share most of their blocks. `stars` has each member's similarity to its centre. Members that links connect to the centre need no
    comparison with each other. All else is compared in pairs of chunks of members at like distances from the centre: the share of differing shingles
    is a metric, so chunks further apart than a similar pair can be are left out, as are chunks whose sizes differ too much. A pair of
    chunks is one group, compared on whole sets, and gives a spanning forest of its links; the pairs themselves are never rows.
    """
    label = connected_components(links).select("node", "component")
    far = 1 - similarity + 1e-9
    placed = hot.join(stars.select(F.col("a").alias("centre"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("d")), ["centre", "id"])
    for c in ("id", "centre"):
        placed = placed.join(label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")), c, "left")
    # chunks are bands of the distance, as many as the group's sets need, and parts of these by hash where a band is still too large
    size = F.ceil(F.sum(F.col("n") + EACH) / chunk)
    placed = materialise(placed.select("centre", "id", "n", "d", (F.coalesce("id_component", "id") == F.coalesce("centre_component", "centre")).alias("main")), "similar-distances")
    bands = placed.groupBy("centre", "main").agg(F.least(size, F.lit(32)).alias("bands"))
    placed = materialise(placed.join(bands, ["centre", "main"]).withColumn("band", F.floor(F.col("d") * F.col("bands"))), "similar-bands")
    place = ["centre", "main", "band"]
    parts = placed.groupBy(*place).agg(size.alias("parts"))
    part = F.concat_ws(".", F.col("main").cast("int"), "band", F.pmod(F.xxhash64("id"), F.col("parts")))
    placed = materialise(placed.join(parts, place).select("centre", "id", "n", "d", "main", part.alias("part")), "similar-chunks")
    boxes = placed.groupBy("centre", "part", "main").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = (boxes.select("centre", *[F.col(c).alias(f"{s}_{c}") for c in boxes.columns[1:]]) for s in "xy")
    apart = (F.col("x_near") - F.col("y_far") > far) | (F.col("y_near") - F.col("x_far") > far) | (F.col("x_most") < similarity * F.col("y_least") - 1e-9) | (F.col("y_most") < similarity * F.col("x_least") - 1e-9)
    met = x.join(y, "centre").filter((F.col("x_part") <= F.col("y_part")) & ~(F.col("x_main") & F.col("y_main")) & ~apart).select("centre", "x_part", "y_part")
    sides = F.explode(F.array_distinct(F.array("x_part", "y_part"))).alias("part")
    members = met.select("*", sides).join(placed.select("centre", "part", "id"), ["centre", "part"]).join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        parts, ids = np.array(table.column("part")), np.array(table.column("id"))
        one, two = table.column("x_part")[0].as_py(), table.column("y_part")[0].as_py()
        every = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        xs, ys = np.flatnonzero(parts == one), np.flatnonzero(parts == two)
        found: list[tuple[int, int]] = []
        if len(xs) and len(ys):
            size = np.array([len(s) for s in every])
            common = common_counts([every[i] for i in xs], [every[i] for i in ys])
            alike = common / (size[xs][:, None] + size[ys][None, :] - common) >= similarity
            near = np.zeros((len(ids), len(ids)), dtype=bool)
            near[np.ix_(xs, ys)] = alike
            near[np.ix_(ys, xs)] = alike.T
            found = spanning_links(near)
        return pa.table({"a": pa.array([int(ids[u]) for u, _ in found], pa.int64()), "b": pa.array([int(ids[v]) for _, v in found], pa.int64())})

    return members.select("centre", "x_part", "y_part", "part", "id", "shingles").groupBy("centre", "x_part", "y_part").applyInArrow(compare, "a long, b long")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, max_block: int = 24, chunk: int = CHUNK) -> DataFrame:
    """As near_duplicates, for documents that share at least `similarity` of their shingles: rows (doc_id, key, fp, component_id, component_key); the keys
    are hashes of the texts, and component_key is that of the component's least document (null ids last, ties to the lesser key).

    At such a similarity whole fingerprints differ in about ten bits, too many for blocks of their bits to select. Blocks are
    shingles and hashes of small classes of the shingle set instead (`class_blocks`). Pairs that share one, if neither set is too large for the other, are estimated
    from their sketches; those not far below the similarity are decided on their whole shingle sets, which are worked out anew from the texts. Documents of
    one shingle set are one node. Where more than max_block nodes share a block, each is compared with the one whose blocks meet most others (the
    likely original), and those that this does not connect are compared with all others by chunks (`hot_links`). Nulls, empty texts, ties and repeats as in near_duplicates.
    """
    bound_batches(docs)
    found = materialise(signatures(docs, doc_id, text, shingle, similarity, common_shingles(docs, text, shingle, similarity)), "similar")
    node = F.struct("whole", "n")
    nodes = found.groupBy(node.alias("node")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    nodes = materialise(nodes.select(F.xxhash64("node.whole", "node.n").alias("id"), "least", F.col("least.key").alias("key")), "similar-nodes")
    named = found.withColumn("id", F.xxhash64("whole", "n"))
    blocks = named.groupBy("id").agg(F.min("n").alias("n"), F.first("blocks").alias("blocks")).select("id", "n", F.explode("blocks").alias("block"))
    sizes = blocks.groupBy("block").count().filter("count > 1")
    met = materialise(blocks.join(sizes, "block"), "similar-blocks")
    cold, hot = met.filter(F.col("count") <= max_block), met.filter(F.col("count") > max_block).select("block", "id", "n")
    sized = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9
    a, b = (cold.select("block", F.col("id").alias(c), F.col("n").alias(f"{c}_n")) for c in "ab")
    candidates = materialise(a.join(b, "block").filter((F.col("a") < F.col("b")) & sized).select("a", "b").distinct(), "similar-pairs")
    ends = F.explode(F.array("a", "b")).alias("id")
    some = mark_maybe(named.select("id", "sketch"), F.col("id"), candidates.select(ends)).filter("maybe")
    sketches = materialise(some.join(candidates.select(ends).distinct(), "id", "left_semi").select("id", "sketch").dropDuplicates(["id"]), "similar-sketches")
    compared = candidates.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("a_sketch")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("b_sketch")), "b")
    # a quarter below is eight standard errors of a full sketch
    likely = materialise(sketch_similarity(compared.select("a", "b", "a_sketch", "b_sketch")).filter(F.col("similarity") >= 0.75 * similarity).select("a", "b"), "similar-likely")
    wanted = likely.select(ends).unionByName(hot.select("id")).distinct()
    wanted = materialise(nodes.join(wanted, "id").select("id", "key"), "similar-wanted")
    sets = materialise(shingle_sets(docs, text, shingle, wanted), "similar-sets")
    alike = F.col("similarity") >= similarity
    links = materialise(whole_similarity(likely, sets).filter(alike).select("a", "b"), "similar-links")
    spent = [found, nodes, met, candidates, sketches, likely, wanted, sets, links]
    if not hot.isEmpty():
        degree = met.groupBy("id").agg(F.sum("count").alias("degree"))
        centres = materialise(hot.join(degree, "id").groupBy("block").agg(F.max(F.struct("degree", "id")).alias("c")).select("block", F.col("c.id").alias("centre")), "similar-centres")
        hot = materialise(hot.join(centres, "block").filter("id <> centre").select("centre", "id", "n").distinct(), "similar-hot")
        stars = hot.select(F.col("centre").alias("a"), F.col("id").alias("b"))
        stars = materialise(whole_similarity(stars, sets), "similar-stars")
        links = links.unionByName(stars.filter(alike).select("a", "b"))
        links = links.unionByName(hot_links(hot, stars, links, sets, similarity, chunk))
        spent += [centres, hot, stars]
    groups = connected_components(links)
    member = nodes.join(groups.withColumnRenamed("node", "id"), "id").groupBy("component").agg(F.min("least").alias("first"))
    labels = groups.join(member, "component").select(F.col("node").alias("id"), "first")
    of = nodes.join(labels, "id", "left").select("id", F.coalesce("first", "least").alias("first"))
    out = found.select("doc_id", "key", "fp", F.xxhash64("whole", "n").alias("id")).join(of, "id").select("doc_id", "key", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("component_key"))
    out = materialise(out, "similar-groups")
    # what is as large as the texts does not wait for the end of the session
    for frame in [*spent, groups]:
        discard(frame)
    return out


def keep_one(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of groups (as similar_documents gives them) one row of docs, with docs' own columns: that of the component's id and text.

    Unlike texts that share an id are told apart; a row with a null id goes if its component has a row with one. Rows that repeat the kept id and
    text count as one document, of which any one stays. Rows move only where a join needs it: what goes is few, and other rows but few stay in place by their marks.
    """
    ids = groups.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first((F.col("doc_id").eqNullSafe(F.col("component_id"))) & (F.col("key") == F.col("component_key"))).alias("kept"))
    odd = materialise(ids.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("id"), "key", "kept"), "similar-removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("key"))

    def same(other: DataFrame) -> Column:
        return rows["id"].eqNullSafe(other["id"]) & (rows["key"] == other["key"])

    marked = mark_maybe(rows, F.xxhash64("id", "key"), odd.select(F.xxhash64("id", "key")))
    clear, rows = marked.filter("NOT maybe"), marked.filter("maybe")
    once = rows.join(odd, same(odd), "left_anti")
    repeated = odd.filter("kept")
    return clear.unionByName(once).unionByName(rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["id", "key"])).select("row.*")
