"""Spelling variants: words one edit apart, found by Gram matrices of letter counts within small blocks, and the common form that each leads to."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Words of at most so many code points are verified as rows of a matrix, longer ones pair by pair.
WIDE = 64
#: Rows of a Gram matrix, if no block is larger.
CHUNK = 512
PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def corpus_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 7, copies: int = 2, drop_every: int = 0) -> DataFrame:
    """Rows (word, n): distinct runs of Latin letters in whole texts, A-Z lower-cased, of at least `least` code points and `copies` occurrences.

    With drop_every, a run of which crc32("<doc_id>:<run>") is a multiple of it loses the code point at that number modulo its length before it counts
    (planted misspellings). A null text has no words, a null id counts as an empty one; repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), 0)).alias("run"))
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if drop_every:
        runs = runs.select(word.alias("run"), F.crc32(F.concat("id", F.lit(":"), word).cast("binary")).alias("h"))
        at = F.pmod("h", F.char_length("run")).cast("int")
        word = F.when(F.pmod("h", F.lit(drop_every)) == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= copies)


def _blocks(visitor: bool, start: Column, end: Column) -> Column:
    """What a word is under the two halves of the open places start..end of its block: all code points outside must agree.

    In a block of length L words of that length stand at home and those of length L + 1 visit: theirs is one open place more.
    """
    middle = F.floor((start + end) / 2).cast("int")
    size = F.char_length("word") - int(visitor)
    return F.array(*[F.struct(F.xxhash64(size, a, b, F.substr("word", F.lit(1), a), F.substr("word", b + 1 + int(visitor))).alias("key"), F.lit(visitor).alias("visitor"), a.alias("s"), b.alias("e")) for a, b in ((start, middle), (middle, end))])


def _split(rows: DataFrame) -> DataFrame:
    """The rows of blocks, each under the two halves of its open places."""
    s, e = F.col("s"), F.col("e")
    return rows.select("word", "n", F.explode(F.when(F.col("visitor"), _blocks(True, s, e)).otherwise(_blocks(False, s, e))).alias("b")).select("b.*", "word", "n")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, padded by zeros."""
    return np.array([w[:width] for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row a word: how often each code point of the block occurs in it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters, at = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
    cells = np.repeat(np.arange(len(words)), sizes) * len(letters) + at
    return np.bincount(cells, minlength=len(words) * len(letters)).reshape(len(words), -1).astype(np.float32)


def edit_place(a: str, b: str) -> int:
    """The first place in which a and b differ if they are exactly one edit apart (b as long as a, or longer by one); else -1."""
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return p if a != b and a[p + 1 if len(a) == len(b) else p :] == b[p + 1 :] else -1


def edit_places(words: list[str], sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """edit_place for many pairs of words (sizes[j] is sizes[i] or one more)."""
    width = int(sizes.max()) + 1 if len(sizes) else 1
    if width > WIDE + 1:
        return np.fromiter((edit_place(words[x], words[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    codes = _codes(words, width)
    a, b = codes[i], codes[j]
    unlike = a != b
    place = np.where(unlike.any(1), unlike.argmax(1), -1)
    after = np.arange(width)[None, :] > place[:, None]
    same = sizes[i] == sizes[j]
    one = (place >= 0) & np.where(same, ~(unlike & after).any(1), ~((a[:, :-1] != b[:, 1:]) & (after[:, :-1] | (np.arange(width - 1)[None, :] == place[:, None]))).any(1))
    return np.where(one, place, -1)


def near_pairs(key: np.ndarray, visitor: np.ndarray, start: np.ndarray, end: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one block whose words are one edit apart, each in the one block that holds the edit's first place.

    Squared distances of letter counts, by one matrix product, leave the pairs at most two apart; these are verified.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = letter_counts(words)
    gram = counts @ counts.T
    norms = np.diagonal(gram)
    # a word at home with the later ones at home, and with all visitors, which are longer by one
    meet = (key[:, None] == key[None, :]) & (start[:, None] == start[None, :]) & (end[:, None] == end[None, :]) & ~visitor[:, None]
    meet &= visitor[None, :] | (np.arange(len(words))[:, None] < np.arange(len(words))[None, :])
    i, j = np.nonzero(meet & (norms[:, None] + norms[None, :] - 2 * gram <= 2))
    fits = sizes[j] == sizes[i] + visitor[j]
    i, j = i[fits], j[fits]
    place = edit_places(words, sizes, i, j)
    held = (place >= start[i]) & ((place < end[i]) | ((place == end[i]) & (end[i] == sizes[i])))
    return i[held], j[held]


def _of_bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    table = table.take(pa.array(order))
    key, visitor, start, end, n = (table.column(c).to_numpy() for c in ("key", "visitor", "s", "e", "n"))
    words, ends, at, block = table.column("word").to_pylist(), np.cumsum(sizes), 0, 0
    while at < len(words):  # whole blocks side by side in one matrix
        block = max(block + 1, int(np.searchsorted(ends, at + CHUNK, "right")))
        piece = slice(at, at := int(ends[block - 1]))
        some = words[piece]
        i, j = near_pairs(key[piece], visitor[piece], start[piece], end[piece], some)
        if len(i):
            left, right = [some[x] for x in i.tolist()], [some[x] for x in j.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(left + right), pa.array(right + left), pa.array(np.concatenate([n[piece][j], n[piece][i]]))], schema=PAIRS)


def near_words(words: DataFrame, max_block: int = 1024) -> DataFrame:
    """Rows (word, near, near_n), both ways: the distinct words (word, n) that are exactly one inserted, deleted or replaced code point apart.

    The blocks of one length, and of the length above as visitors, are cut by halves: one edit leaves all code points outside one half alone, so
    near words share a block of that half. Blocks of over max_block rows are cut again, half of the open places at a time, down to
    one open place, where letters bound them; no word is dropped and no pair lost. What remains are blocks of bounded size, each a piece of a Gram matrix.
    """
    whole = words.select(F.lit(False).alias("visitor"), F.lit(0).alias("s"), F.char_length("word").alias("e"), "word", "n")
    rows = _split(whole.unionByName(whole.filter("e > 1").withColumns({"visitor": F.lit(True), "e": F.col("e") - 1})))
    parts = []
    while True:
        large = materialise(rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("e") - F.col("s")).alias("open")).filter((F.col("rows") > max_block) & (F.col("open") > 1)).select("key"), "large-blocks")
        parts.append(rows.join(large, "key", "left_anti"))
        if large.isEmpty():
            break
        rows = materialise(_split(rows.join(large, "key", "left_semi")), "spelling-blocks")
    blocks = parts[0]
    for p in parts[1:]:
        blocks = blocks.unionByName(p)
    size = words.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    buckets = max(8, math.ceil(size[0] / 25_000), math.ceil((size[1] or 0) / (2 << 20)))
    return blocks.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_grouped, "word string, near string, near_n long")


def _grouped(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_of_bucket(table), PAIRS)


def group_variants(words: DataFrame, ratio: int = 10, max_block: int = 1024) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for each of the distinct words (word, n).

    A word's form is its near word of largest n (ties: the least in code-point order), if that is at least `ratio` times the word's own n, else null.
    root follows forms to the last and is the word itself without one; n grows along the way, so it ends. An empty table gives none.
    """
    near = near_words(words, max_block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    leads = -F.col("best.less") >= F.col("n") * ratio
    known = materialise(words.join(near, "word", "left").select("word", F.when(leads, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, -F.col("best.less")).alias("form_n")), "variants")
    roots = materialise(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the way that a word has followed
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("later"))
        last, roots = roots, materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")), "roots")
        done = roots.filter("moved").isEmpty()
        roots = roots.drop("moved")
        discard(last)
        if done:
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
