"""Benchmark decontamination: suffix arrays over shards of the training words, searched for every benchmark suffix."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, materialise, text_slices, whole_rows

# Word characters are digits, letters and all beyond ASCII; A-Z are lower-cased; any other byte separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCHES = "array<struct<item_id:string,doc_start:int,item_start:int,length:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class TestSet:
    """One block of the benchmark: its words as numbers from 1, and its distinct windows with the places they come from."""

    vocab: dict[bytes, int]
    keys: np.ndarray  # the windows' words, big-endian, padded with zeros
    last: np.ndarray  # the same padded with the largest value: the end of the range of suffixes that start with the window
    lengths: np.ndarray
    holders: list[list[int]]  # of each window: the items that hold it
    names: list[str]
    words: list[np.ndarray]  # of each item
    arrays: dict[int, np.ndarray] = field(default_factory=dict)  # suffix arrays of the items met so far

    @classmethod
    def of(cls, items: list[tuple[str, bytes | None]], window: int) -> TestSet:
        vocab: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], dict[int, None]] = {}
        words = []
        for i, (_, text) in enumerate(items):
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
            words.append(np.array(ids, dtype=np.int32))
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                holders.setdefault(tuple(ids[j : j + window]), {})[i] = None
        keys = np.zeros((len(holders), window), dtype=">u4")
        last = np.full((len(holders), window), 0xFFFFFFFF, dtype=">u4")
        for row, w in enumerate(holders):
            keys[row, : len(w)] = last[row, : len(w)] = w
        return cls(vocab, packed(keys), packed(last), np.array([len(w) for w in holders], dtype=np.int64), [list(h) for h in holders.values()], [name for name, _ in items], words)

    def longest(self, item: int, text: list[int], at: int) -> tuple[int, int]:
        """(words, start in the item) of the longest run of the text from `at` on that the item holds, by halving its suffix array word by word."""
        words = self.words[item]
        if item not in self.arrays:
            self.arrays[item] = whole_suffix_array(words)
        order, n = self.arrays[item], len(words)
        low, high, k = 0, len(order), 0
        while at + k < len(text):
            w, depth = text[at + k], k

            def word(r: int, depth: int = depth) -> int:
                place = int(order[r]) + depth
                return int(words[place]) if place < n else -1

            first = bisect_left(range(n), w, low, high, key=word)
            end = bisect_right(range(n), w, first, high, key=word)
            if first == end:
                break
            low, high, k = first, end, k + 1
        return k, int(order[low:high].min())


def whole_suffix_array(words: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the depth to which they are ranked."""
    rank, depth = np.unique(words, return_inverse=True)[1] + 1, 1
    while True:
        after = np.zeros_like(rank)
        after[:-depth] = rank[depth:] if depth < len(rank) else 0
        order = np.lexsort((after, rank))
        new = np.concatenate([[1], (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)]).cumsum()
        rank = np.empty_like(new)
        rank[order] = new
        if new[-1] == len(new):
            return order
        depth *= 2


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(flat: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of suffixes, sorted by their first `depth` words, and these words as keys.

    Word 0 stands for any word that the test set lacks, and for the end of a document. Suffixes that meet it before `least` words
    can match nothing and are left out; words after it are blanked.
    """
    stops = np.append(np.flatnonzero(flat == 0), len(flat))
    room = stops[np.searchsorted(stops, np.arange(len(flat)))] - np.arange(len(flat))
    starts = np.flatnonzero(room >= least)
    at = starts[:, None] + np.arange(depth)
    keys = packed(np.where(np.arange(depth) < room[starts][:, None], np.append(flat, np.zeros(depth, flat.dtype))[at], 0).astype(">u4"))
    order = np.argsort(keys, kind="stable")
    return starts[order], keys[order]


def shard_matches(docs: list[list[int]], tests: TestSet, window: int) -> list[list[tuple[str, int, int, int]]]:
    """Of each document (words as numbers, 0 for others): its longest verbatim matches of at least a window."""
    ends = np.cumsum([len(d) + 1 for d in docs])
    flat = np.fromiter((w for d in docs for w in (*d, 0)), dtype=np.int64, count=int(ends[-1]) if docs else 0)
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in docs]
    if not len(tests.lengths) or not len(flat):
        return out
    starts, keys = suffix_array(flat, window, int(tests.lengths.min()))
    low, high = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.last, "right")
    whole = tests.lengths == window
    high[whole] = np.searchsorted(keys, tests.keys[whole], "right")
    runs: dict[tuple[int, int], list[np.ndarray]] = {}
    for w in np.flatnonzero(high > low):
        found = np.sort(starts[low[w] : high[w]])
        of = np.searchsorted(ends, found, "right")
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            for item in tests.holders[w]:
                runs.setdefault((int(of[x]), item), []).append(found[x:y])
    # the longest match from the first window on, then from the first window that it does not contain, and so on
    for (d, item), parts in sorted(runs.items()):
        places, first, i = np.unique(np.concatenate(parts)) - (ends[d] - len(docs[d]) - 1), min(window, len(tests.words[item])), 0
        while i < len(places):
            at = int(places[i])
            length, start = tests.longest(item, docs[d], at)
            out[d].append((tests.names[item], at, start, length))
            i = int(np.searchsorted(places, at + length - first, "right"))
    return out


def covered(matches: list[dict], n_words: int) -> int:
    marks = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(marks, [m["doc_start"] for m in matches], 1)
    np.add.at(marks, [m["doc_start"] + m["length"] for m in matches], -1)
    return int((np.cumsum(marks) > 0).sum())


def _pass(frame: DataFrame, tests: TestSet, window: int) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = known.vocab.get
        for part in text_slices(batches, 1):
            split = [words_of(t) for t in as_bytes(part.column(1))]
            found = shard_matches([[number(w, 0) for w in words] for words in split], known, window)
            matches = [old + [dict(zip(("item_id", "doc_start", "item_start", "length"), m, strict=True)) for m in new] for old, new in zip(part.column(2).to_pylist(), found, strict=True)]
            hit = [covered(m, len(w)) if m else 0 for m, w in zip(matches, split, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(matches, part.schema.field(2).type), pa.array([len(w) for w in split], pa.int64()), pa.array(hit, pa.int64())], ["row", "text", "matches", "n_words", "n_hit"])

    return frame.select("row", "text", "matches").mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, text string, matches {MATCHES}, n_words long, n_hit long")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Rows (row, matches, n_words, n_hit), one per input row: row is the whole input row as a struct.

    matches are the longest verbatim runs of at least `window` words (or of a whole shorter item) that the document shares with
    an item: (item_id as text, start word in the document, first such start word in the item, words). For each item they run from left to right, each
    the longest from its start, which is the first window not inside the match before; so texts that repeat themselves give few. n_hit counts the document's words
    inside any occurrence of a window. A null or wordless text has no words and no match; wordless items match nothing; items of
    one id count as one; a null item_id is the empty string. Repeated rows are judged alike; an empty table gives no rows.

    The benchmark is sent to the workers in blocks of about block_bytes (measured first), one pass over the rows for each block, and what a pass
    finds is written before the next starts, so one block is held at a time; the documents are neither shuffled nor joined.
    """
    bound_batches(docs)
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{item_text}`").cast("string").cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = whole_rows(docs, text).withColumn("matches", F.expr(f"CAST(array() AS {MATCHES})"))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        if b:
            out = materialise(out, "benchmark-block")
        out = _pass(out, TestSet.of(sorted((r.item_id, bytes(r.text) if r.text is not None else b"") for r in block.collect()), window), window)
    return out.select("row", "matches", "n_words", "n_hit")


def contaminated(one_in: int = 20) -> Column:
    """True if at least one in so many of a document's words, and any, is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, **names: str) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' own columns."""
    return benchmark_matches(docs, benchmark, window, **names).filter(~contaminated(one_in)).select("row.*")
