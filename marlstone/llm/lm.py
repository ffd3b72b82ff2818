"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts (after Talbot and Osborne)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bound_batches, crc_fold, materialise, text_slices, whole_rows

WORD = np.uint64(0xFFFFFFFFFFFFFFFE)  # keys of words have a last bit of 0, those of longer n-grams one of 1
END = xxhash.xxh3_64_intdigest(b"\n") & int(WORD)  # no word holds white space
START = xxhash.xxh3_64_intdigest(b"\n\n") & int(WORD)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
LOW = np.uint64(0xFFFFFFFF)
ENTRY = 16  # bytes of a word and its count
FETCH = 16 << 20  # bytes of segments that come to the driver at a time


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of each pair of 64-bit numbers."""
    x = a * M1 + b
    x ^= x >> np.uint64(32)
    x *= M2
    x ^= x >> np.uint64(29)
    x *= M3
    return x ^ (x >> np.uint64(32))


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


def tokenise(texts: list[bytes | None]) -> Tokens:
    """Hashes of the distinct words (the end first), the texts' tokens as places among them, each text ended, and the texts' token counts.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a null text has no words.
    """
    split = [t.lower().split() if t else [] for t in texts]
    place: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)), 1)}
    hashes = np.fromiter(chain([END], map(xxhash.xxh3_64_intdigest, place)), np.uint64, len(place) + 1) & WORD
    sizes = np.array([len(s) + 1 for s in split], dtype=np.int64)
    ids = np.zeros(int(sizes.sum()), dtype=np.int64)
    words = np.ones(len(ids), dtype=bool)
    words[sizes.cumsum() - 1] = False
    ids[words] = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, len(ids) - len(sizes))
    return hashes, ids, sizes


def grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to order; each text is preceded by a start symbol."""
    out, first = [tokens], sizes.cumsum() - sizes
    history = tokens
    for n in range(2, order + 1):
        before = np.empty_like(history)
        before[1:] = history[:-1]
        before[first] = START
        history = mix(before, tokens)
        out.append(mix(history, np.uint64(n)) | ~WORD)
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """The quantised count, from 1."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def middle(levels: np.ndarray, base: float) -> np.ndarray:
    """The middle of each level's counts; 0 for level 0."""
    low = base ** (levels - 1.0)
    return np.where(levels > 0, (low + np.maximum(base ** (levels * 1.0) - 1, low)) / 2, 0.0)


def seeds(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (key, step), whose combinations are its probes."""
    h = mix(keys, np.uint64(1000 + step))
    return h & LOW, (h >> np.uint64(32)) | np.uint64(1)


def probe(low: np.ndarray, high: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The bit, within bits, of the probe of number i."""
    return (((low + np.uint64(i) * high) & LOW) * bits) >> np.uint64(32)


def filter_segment(keys: np.ndarray, levels: np.ndarray, bits_per_entry: float, hashes: int) -> bytes:
    """Bits with (key, step) entered for each step from 1 to the key's level: bits_per_entry for each, whatever the size."""
    bits = 8 * max(1, math.ceil(int(levels.sum()) * bits_per_entry / 8))
    marks = np.zeros(bits, dtype=bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        low, high = seeds(keys[levels >= step], step)
        for i in range(hashes):
            marks[probe(low, high, i, np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """Segments, chosen by the leading bits of a key, in one buffer."""

    data: np.ndarray
    starts: np.ndarray  # first bit of each segment
    bits: np.ndarray
    hashes: int

    @classmethod
    def of(cls, data: np.ndarray, sizes: np.ndarray, hashes: int) -> LogFrequencyFilter:
        """Of segments of sizes bytes each, joined in data."""
        bits = 8 * sizes.astype(np.uint64)
        return cls(data, np.cumsum(bits) - bits, bits, hashes)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it is not in the filter; errors are one-sided (never too low)."""
        out = np.zeros(len(keys), dtype=np.int64)
        shift = np.uint64(64 - (len(self.bits) - 1).bit_length())
        segment = (keys >> shift).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(keys), np.int64)
        alive, step = np.arange(len(keys)), 1
        while len(alive):
            low, high = seeds(keys[alive], step)
            start, bits = self.starts[segment[alive]], self.bits[segment[alive]]
            for i in range(self.hashes):  # one probe at a time, since most absent keys fail early
                at = start + probe(low, high, i, bits)
                held = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not held.all():
                    low, high, start, bits, alive = (x[held] for x in (low, high, start, bits, alive))
            out[alive] = step
            step += 1
        return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: differences, by byte plane, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(keys), -1).T).tobytes() for x in (gaps, counts.astype(np.uint32))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=12 * n), np.uint8)
    gaps, counts = (np.ascontiguousarray(planes[x : x + w * n].reshape(w, n).T).reshape(-1).view(t) for x, w, t in ((0, 8, np.uint64), (8 * n, 4, np.uint32)))
    return np.cumsum(gaps, dtype=np.uint64), counts


def ngram_counts(docs: DataFrame, text: str = "text", order: int = 2, bits: int = 3, run_tokens: int = 2_000_000) -> DataFrame:
    """Rows (segment, n, run): packed counts of the n distinct n-grams, of up to order words, that runs of documents send to a segment (the keys' leading bits)."""

    def sent(runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(runs)
        runs.clear()
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts, keys = np.diff(first, append=len(keys)), keys[first]
        segment = keys >> np.uint64(64 - bits)
        cuts = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1, [len(keys)]]).tolist()
        for at in range(0, len(cuts) - 1, 256):
            ends = list(zip(cuts[at : at + 256], cuts[at + 1 : at + 257], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(segment[x]) for x, _ in ends], pa.int32()), pa.array([y - x for x, y in ends], pa.int64()), pa.array([pack(keys[x:y], counts[x:y]) for x, y in ends], pa.binary())], ["segment", "n", "run"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[np.ndarray] = []
        held = 0
        for part in text_slices(batches):
            known, ids, sizes = tokenise(as_bytes(part.column(0)))
            runs += grams(known[ids], sizes, order)
            held += len(ids)
            if held >= run_tokens:
                yield from sent(runs)
                held = 0
        if runs:
            yield from sent(runs)

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(gather, "segment int, n long, run binary")


def count_segments(docs: DataFrame, text: str = "text", order: int = 2, base: float = 2.0, bits_per_entry: float = 8, hashes: int = 4, segment_bytes: int = 16 << 20) -> DataFrame:
    """Rows (segment, segments, words, tokens, keys, counts, filter): exact counts of the words and the filter of all n-grams of a range of keys.

    All rows and all n-grams count, those seen once too. There is a segment for about segment_bytes of text, so their number grows with
    the corpus and the size of one does not (a run of documents sends a row to each segment that its n-grams meet, so never more rows than n-grams); the filter has bits_per_entry bits for each level of each n-gram at every size.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    bits = min(31, max(3, math.ceil(math.log2(max(1, size / segment_bytes)))))

    def merge(table: pa.Table) -> pa.Table:
        runs = [unpack(r, n) for r, n in zip(table.column("run").to_pylist(), table.column("n").to_pylist(), strict=True)]
        keys, n = summed(np.concatenate([k for k, _ in runs]), np.concatenate([c.astype(np.int64) for _, c in runs]))
        word = keys & ~WORD == 0
        held = filter_segment(keys, level(n, base), bits_per_entry, hashes)
        columns = [[table.column("segment")[0].as_py()], [1 << bits], [int(word.sum())], [int(n[word].sum())], [keys[word].tobytes()], [n[word].tobytes()], [held]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["segment", "segments", "words", "tokens", "keys", "counts", "filter"])

    rows = ngram_counts(docs, text, order, bits)
    return materialise(rows.groupBy("segment").applyInArrow(merge, "segment int, segments int, words long, tokens long, keys binary, counts binary, filter binary"), "lm-counts")


@dataclass
class Model:
    """Scores texts, given ways to look keys up: exact counts of words, and levels of n-grams."""

    tokens: int
    words: int
    order: int
    weight: float
    base: float

    def keys(self, read: Tokens) -> np.ndarray:
        """All keys that scoring the texts looks up."""
        known, ids, sizes = read
        return np.unique(np.concatenate([known, *grams(known[ids], sizes, self.order)[1:]]))

    def score(self, read: Tokens, exact: Callable[[np.ndarray], np.ndarray], levels: Callable[[np.ndarray], np.ndarray]) -> list[pa.Array]:
        """Columns n_tokens, n_known, train_tokens, base_score and score of the texts.

        A token's probability is the linear interpolation of the orders, with add-0.1 smoothing in the lowest.
        """
        known, ids, sizes = read
        count, first = exact(known), sizes.cumsum() - sizes
        total = self.tokens + 0.1 * (self.words + 1)
        base = np.log10((count + 0.1) / total)
        history = middle(levels(known), self.base)
        starts, history = history[0], history[ids]  # as many texts start as end
        p = (history + 0.1) / total
        for gram in grams(known[ids], sizes, self.order)[1:]:
            n = middle(levels(gram), self.base)
            seen = np.empty_like(history)
            seen[1:] = history[:-1]
            seen[first] = starts
            p = self.weight * n / np.maximum(np.maximum(seen, n), 1) + (1 - self.weight) * p
            history = n
        sums = [np.add.reduceat(x, first) if len(first) else x for x in ((count > 0).astype(np.int64)[ids], base[ids], np.log10(p))]
        return [pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), self.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])]


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values at the wanted keys, 0 where they are absent; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


MEASURES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _scored(rows: DataFrame) -> T.StructType:
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 2
    return T.StructType([rows.schema["row"], *[T.StructField(m, t) for m, t in zip(MEASURES, kinds, strict=True)]])


def _score_by_broadcast(rows: DataFrame, segments: DataFrame, n_segments: int, model: Model, hashes: int) -> DataFrame:
    """Scores in one pass over the rows, with the whole filter and all word counts in the workers."""
    bytes_of, words_of = np.ones(n_segments, np.int64), np.zeros(n_segments, np.int64)
    for r in segments.select("segment", F.octet_length("filter").alias("bytes"), "words").collect():
        bytes_of[r.segment], words_of[r.segment] = r.bytes, r.words
    at, place = np.cumsum(bytes_of) - bytes_of, np.cumsum(words_of) - words_of
    held, words, counts = np.zeros(int(bytes_of.sum()), np.uint8), np.empty(int(words_of.sum()), np.uint64), np.empty(int(words_of.sum()), np.int64)
    first = 0
    while first < n_segments:  # a few segments at a time, straight into their places
        last = first + max(1, int(np.searchsorted((bytes_of + ENTRY * words_of)[first:].cumsum(), FETCH, "right")))
        for r in segments.filter(F.col("segment").between(first, last - 1)).select("segment", "keys", "counts", "filter").collect():
            i = r.segment
            held[at[i] : at[i] + bytes_of[i]] = np.frombuffer(r["filter"], np.uint8)
            words[place[i] : place[i] + words_of[i]], counts[place[i] : place[i] + words_of[i]] = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
        first = last
    shared = rows.sparkSession.sparkContext.broadcast((held, words, counts))
    del held, words, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, of = shared.value
        probed = LogFrequencyFilter.of(held, bytes_of, hashes)
        for part in text_slices(batches, 1, 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), *model.score(tokenise(as_bytes(part.column(1))), lambda k: lookup(words, of, k), probed.levels)], ["row", *MEASURES])

    return rows.mapInArrow(run, _scored(rows))


def _score_by_shuffle(rows: DataFrame, text: str, segments: DataFrame, n_segments: int, model: Model, hashes: int, pack_bytes: int, parts: int = 4) -> DataFrame:
    """Scores with each filter segment in one task only: packs of texts send it the keys they look up, once each, and get counts and levels back.

    Work and traffic are in proportion to the rows. A task holds one pack, or one segment with what is asked of it, at most each of its keys once a pack. Keys are most of the traffic, so
    packs ask in a few parts, one after the other, and the files of a part go before the next; a text is on disk once, and once more as the packs meet their answers.
    """
    row = rows.schema["row"].dataType
    # the place of the text in the row itself, unless it is no string there
    own = [i for i, f in enumerate(row.fields) if f.name.lower() == text.lower() and isinstance(f.dataType, T.StringType)]
    shift = np.uint64(64 - (n_segments - 1).bit_length())

    def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pack_bytes
        for part in text_slices(batches, 1, max(1, pack_bytes // 8)):
            if held >= pack_bytes:
                name, held = uuid.uuid4().int >> 65, 0
            held += part.column(1).nbytes
            yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.int64()), part.column(0), *([] if own else [part.column(1)])], names)

    names = ["pack", "row", *([] if own else ["text"])]
    packed = T.StructType([T.StructField("pack", T.LongType()), rows.schema["row"], *([] if own else [T.StructField("text", T.StringType())])])
    packs = materialise(rows.mapInArrow(packs_of, packed), "lm-packs")

    def read(table: pa.Table) -> Tokens:
        texts = table.column("row").combine_chunks().field(own[0]) if own else table.column("text").combine_chunks()
        return tokenise(as_bytes(texts))

    def ask(table: pa.Table) -> pa.Table:
        keys = model.keys(read(table))
        segment = (keys >> shift).astype(np.int32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(keys)]])
        none = np.zeros(len(keys), np.uint32)
        runs = [pack(keys[x:y], none[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array([table.column("pack")[0].as_py()] * len(runs), pa.int64()), pa.array(segment[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array(runs, pa.binary())], ["pack", "segment", "n", "asked"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            words, of, held = (np.frombuffer(right.column(c)[0].as_py(), t) for c, t in (("keys", np.uint64), ("counts", np.int64), ("filter", np.uint8)))
        else:
            words, of, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.uint8)
        probed = LogFrequencyFilter.of(held, np.array([len(held)]), hashes)
        counts, levels = [], []
        for asked, n in zip(left.column("asked").to_pylist(), left.column("n").to_pylist(), strict=True):
            keys = unpack(asked, n)[0]
            counts.append(lookup(words, of, keys[keys & ~WORD == 0]).tobytes())
            levels.append(probed.levels(keys).astype(np.uint8).tobytes())
        return pa.table({"pack": left.column("pack"), "segment": left.column("segment"), "counts": pa.array(counts, pa.binary()), "levels": pa.array(levels, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        # answers stand in the order of the keys asked for, segment by segment
        right, tokens = right.sort_by("segment"), read(left)
        keys = model.keys(tokens)
        counts, levels = (np.concatenate([np.frombuffer(b, t) for b in right.column(c).to_pylist()]) for c, t in (("counts", np.int64), ("levels", np.uint8)))
        words = keys[keys & ~WORD == 0]
        return pa.table([left.column("row"), *model.score(tokens, lambda k: lookup(words, counts, k), lambda k: lookup(keys, levels, k).astype(np.int64))], ["row", *MEASURES])

    known, answers = segments.select("segment", "keys", "counts", "filter").groupBy("segment"), []
    for i in range(parts):
        asked = packs.filter(F.pmod("pack", F.lit(parts)) == i).groupBy("pack").applyInArrow(ask, "pack long, segment int, n long, asked binary")
        answers.append(materialise(asked.groupBy("segment").cogroup(known).applyInArrow(answer, "pack long, segment int, counts binary, levels binary"), "lm-answers"))
    return packs.groupBy("pack").cogroup(reduce(DataFrame.unionByName, answers).groupBy("pack")).applyInArrow(finish, _scored(packs))


def score_documents(docs: DataFrame, training: Column | None = None, text: str = "text", order: int = 2, weight: float = 0.7, max_broadcast: int = 144 << 20, pack_bytes: int = 4 << 20, **counting: float) -> DataFrame:
    """Rows (row, n_tokens, n_known, train_tokens, base_score, score), one per input row; row is the whole input row as a struct.

    Learns from the rows for which `training` holds (all by default; null does not hold) and scores every row. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) with exact counts; score is the log10 probability under the interpolated n-gram model
    whose counts are probed in the log-frequency filter, into which every training n-gram goes. A null or empty text is its end alone; repeated
    rows count again; an empty table gives none. Distinct words are told apart by 63-bit hashes.

    Filter and word counts are broadcast while both together have at most max_broadcast bytes, which is checked; beyond, the n-grams to be
    probed are shuffled to the filter's segments. Both ways give the same rows.
    """
    bound_batches(docs)
    options = {"base": 2.0, "hashes": 4, **counting}
    segments = count_segments(docs.filter(training) if training is not None else docs, text, order, **options)
    words, tokens, n_segments, size = segments.agg(F.sum("words"), F.sum("tokens"), F.max("segments"), F.sum(F.octet_length("filter") + ENTRY * F.col("words"))).first()
    model, n_segments = Model(tokens or 0, words or 0, order, weight, options["base"]), n_segments or 8
    rows = whole_rows(docs, text)
    if (size or 0) <= max_broadcast:
        return _score_by_broadcast(rows, segments, n_segments, model, options["hashes"])
    return _score_by_shuffle(rows, text, segments, n_segments, model, options["hashes"], pack_bytes)


def score_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, **options: float) -> DataFrame:
    """As score_documents, learning from rows whose crc32 of the id modulo folds is not 0, with held_out; a null id is learned from."""
    fold = F.coalesce(crc_fold(F.col(f"`{doc_id}`"), folds), F.lit(1))
    scored = score_documents(docs, fold != 0, text, **options)
    return scored.withColumn("held_out", F.coalesce(crc_fold(F.col(f"row.`{doc_id}`"), folds), F.lit(1)) == 0)
