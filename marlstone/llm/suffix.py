"""Removal of repeated byte strings: sampled suffixes in a depth-limited radix sort, most significant digits first.

Of every window of `length` bytes one suffix takes part: that at the window's least 16-byte gram by hash (the leftmost, if it stands there
twice), so equal windows have it at equal offsets. Its digits are (1) the gram, (2) the rest of the windows that it stands for, from the first
byte of the first to the last byte of the last, (3) the single windows. A pass orders suffixes by one digit, the first two by hashes of their
bytes (104 bits in all); suffixes alone under the first digit go no further, those of one second digit are equal through the threshold, so all but the earliest document's windows are
repeats, and only where one gram has several second digits that also agree on one side of it (of the bytes that a window adds to its gram, half or more stand on
one side, so equal windows agree there) are single windows ordered, by a radix sort over their bytes (`equal_groups`).
Equal groups of its last pass are exactly the repeated windows. Where very many second digits share a gram, its windows are dealt by all their bytes, each once
a group of documents, so that no string gathers in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, materialise, text_slices

GRAM = 16
UNIT = 96 << 10  # bytes of documents worked on at a time, so that arrays stay in a core's cache
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
SPANS = "array<struct<start:long,end:long>>"
SIDE_BITS = 16  # of the hash of the bytes on one side of a gram; 0 says that no window reaches that far
SIDE = np.uint64((1 << SIDE_BITS) - 1)


@dataclass
class Suffixes:
    """The sampled suffixes of a group's documents, in order of place. Offsets are into the documents' joined bytes."""

    doc: np.ndarray  # place of the document in the group
    low: np.ndarray  # first and last start of the windows it stands for
    high: np.ndarray
    place: np.ndarray  # start of the gram
    gram: np.ndarray  # first digit
    rest: np.ndarray  # second digit
    sides: np.ndarray  # hashes of the bytes before and after the gram that any window with half of its other bytes there has


def _half(length: int) -> int:
    """Of the bytes that a window adds to its gram, so many or more stand before it or after it."""
    return (length - GRAM + 1) // 2


def _sides(h: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Two hashes in one number: of the half bytes before the gram at place and of those after it, 0 where no window that starts at low to high holds them. h has the hash of the gram at each place."""
    half = _half(length)
    out = np.zeros(len(place), np.uint64)
    # grams that cover the bytes, and of the gram in between no more than is equal anyway
    before, after = range(-half, 0, GRAM), range(half, 0, -GRAM)
    for held, covers, shift in ((place - low >= half, before, SIDE_BITS), (high + length - GRAM - place >= half, after, 0)):
        at, x = place[held], np.zeros(int(held.sum()), np.uint64)
        for c in covers:
            x = (x ^ h[at + c]) * MULTIPLIERS[2]
            x ^= x >> np.uint64(31)
        out[held] |= (np.uint64(1) + x % SIDE) << np.uint64(shift)
    return out


def sampled_suffixes(data: bytes, starts: np.ndarray, length: int) -> Suffixes:
    """The suffixes of documents that begin at starts (closed by len(data)) in data."""
    span = length - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    first, n_docs = 0, len(starts) - 1
    while first < n_docs:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + UNIT, "right")) - 1)
        begin, end = int(starts[first]), int(starts[last])
        if end - begin >= length:
            h = TABLE[np.frombuffer(data, np.uint8, end - begin, begin)]
            for k, m in enumerate(MULTIPLIERS):
                h = h[: -(1 << k)] * m + h[1 << k :]
            h ^= h >> np.uint64(29)
            h *= MULTIPLIERS[1]
            h ^= h >> np.uint64(32)
            key = (h & HIGH) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if width < span:
                key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
            place = (key & LOW).astype(np.int64)
            windows = np.arange(len(place))
            doc = np.searchsorted(starts[first : last + 1] - begin, windows, "right") - 1
            whole = windows + length <= (starts[first + 1 : last + 1] - begin)[doc]
            windows, place, doc = windows[whole], place[whole], doc[whole]
            if len(windows):
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
                low, high = windows[new], windows[np.concatenate([new[1:] - 1, [len(windows) - 1]])]
                hash_of = xxhash.xxh3_64_intdigest
                rest = np.fromiter((hash_of(data[a:b]) for a, b in zip((low + begin).tolist(), (high + begin + length).tolist(), strict=True)), np.uint64, len(low))
                rest = (rest ^ ((place[new] - low).astype(np.uint64) * MULTIPLIERS[0])) >> np.uint64(8)
                out.append((doc[new] + first, low + begin, high + begin, place[new] + begin, h[place[new]] >> np.uint64(16), rest, _sides(h, place[new], low, high, length)))
        first = last
    if not out:
        none = np.zeros(0, np.int64)
        return Suffixes(none, none, none, none, *[none.astype(np.uint64)] * 3)
    return Suffixes(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers by byte plane, compressed; the first is sorted and kept as differences."""
    n = len(columns[0])
    columns = (np.diff(columns[0].view(np.uint64), prepend=np.uint64(0)), *columns[1:])
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(n, 8).T).tobytes() for c in columns))


def _columns(data: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, 8, n)
    columns = [np.ascontiguousarray(p.T).reshape(-1).view(np.uint64) for p in planes]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def _distinct(*digits: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by digits, then doc: (a first row for each distinct digits, the place of each row among these, the least doc of each)."""
    order = np.lexsort((doc, *reversed(digits)))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for d in digits:
        new[1:] |= d[order][1:] != d[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = new.cumsum() - 1
    first = order[new]
    return first, of, doc[first]


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, doc_id, text) rows as one compressed row for each group met in a slice."""
    for part in text_slices(batches, 2, 4 << 20):
        g, ids, texts = part.column(0).to_numpy(), part.column(1).to_numpy(), [t or b"" for t in as_bytes(part.column(2))]
        order = np.argsort(g, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(g[order])) + 1).tolist(), len(g)]
        rows = [order[x:y].tolist() for x, y in zip(cuts, cuts[1:], strict=False)]
        zstd = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([pa.array([int(g[r[0]]) for r in rows], pa.int32()), pa.array([ids[r] for r in rows], pa.list_(pa.int64())), pa.array([[len(texts[i]) for i in r] for r in rows], pa.list_(pa.int64())), pa.array([zstd.compress(b"".join([texts[i] for i in r])) for r in rows], pa.binary())], ["g", "ids", "sizes", "data"])


@dataclass
class Group:
    """The documents of one group, by (id, text), and their joined bytes."""

    ids: np.ndarray
    texts: list[bytes]
    starts: np.ndarray
    data: bytes

    @classmethod
    def of(cls, table: pa.Table) -> Group:
        texts, zstd = [], zstandard.ZstdDecompressor()
        for sizes, data in zip(table.column("sizes").to_pylist(), table.column("data").to_pylist(), strict=True):
            whole, at = zstd.decompress(data, max_output_size=max(1, sum(sizes))), 0
            for n in sizes:
                texts.append(whole[at : at + n])
                at += n
        ids = np.array([i for r in table.column("ids").to_pylist() for i in r], dtype=np.int64)
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])) if len(np.unique(ids)) < len(ids) else np.argsort(ids).tolist()
        texts = [texts[i] for i in order]
        return cls(ids[order], texts, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), b"".join(texts))


ROW = pa.schema([("kind", pa.int32()), ("g", pa.int32()), ("bucket", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("run", pa.binary()), ("data", pa.binary())])
ROW_DDL = "kind int, g int, bucket int, first long, n long, run binary, data binary"
DIGITS, INTERVALS, CONTEXTS, PLACES, REPEATED, SEVERAL, BEFORE, AFTER, WINDOWS = range(9)
HOT = 512  # second digits of one gram, of those that share a side, above which its windows are dealt one by one


def _row(kind: int, g: int, *columns: np.ndarray, bucket: int = 0, first: int = 0, data: bytes | None = None) -> dict:
    return {"kind": kind, "g": g, "bucket": bucket, "first": first, "n": len(columns[0]), "run": _planes(*(c.astype(np.uint64) for c in columns)), "data": data}


def _sent(kind: int, g: int, buckets: int, *columns: np.ndarray, texts: list[bytes] | None = None) -> list[dict]:
    """A row for each bucket (the leading bits of the gram, the first column, which is sorted), with the columns' part and its texts."""
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(48 - (buckets - 1).bit_length())
    cuts = [0, *np.searchsorted(columns[0], edges).tolist(), len(columns[0])]
    zstd = zstandard.ZstdCompressor(level=3)
    return [_row(kind, g, *(c[x:y] for c in columns), bucket=i, first=x, data=zstd.compress(b"".join(texts[x:y])) if texts is not None else None) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def _share_sides(gram: np.ndarray, sides: np.ndarray) -> list[np.ndarray]:
    """Which rows agree with another of their gram on what is before it, and which on what is after it."""
    out = []
    for side in (sides >> np.uint64(SIDE_BITS), sides & SIDE):
        rows = np.flatnonzero(side)
        rows = rows[np.lexsort((side[rows], gram[rows]))]
        same = (gram[rows[1:]] == gram[rows[:-1]]) & (side[rows[1:]] == side[rows[:-1]])
        out.append(_flags(len(gram), np.concatenate([rows[1:][same], rows[:-1][same]])))
    return out


def _judge_digits(table: pa.Table, hot: int) -> pa.Table:
    """Of each group's rows in a bucket, the places of those whose two digits have a lesser document elsewhere, and of those whose gram has several second digits that
    share a side with another, or very many: then of those that share what is before and of those that share what is after."""
    g, first, n = (table.column(c).to_numpy() for c in ("g", "first", "n"))
    runs = [_columns(r, k) for r, k in zip(table.column("run").to_pylist(), n.tolist(), strict=True)]
    gram, rest, doc, sides = (np.concatenate(c) for c in zip(*runs, strict=True))
    ids = doc.view(np.int64)
    one, of, least = _distinct(gram, rest, doc=ids)
    before, after = _share_sides(gram[one], sides[one])
    met = before | after
    _, which = np.unique(gram[one], return_inverse=True)
    sharing = np.where(met, np.bincount(which[met], minlength=len(one))[which], 0)[of]
    repeated = ids > least[of]
    out, ends = [], np.cumsum(n)
    for kind, found in ((REPEATED, repeated), (SEVERAL, (sharing > 1) & (sharing <= hot) & ~repeated), (BEFORE, (sharing > hot) & ~repeated & before[of]), (AFTER, (sharing > hot) & ~repeated & after[of])):
        for i in range(len(n)):
            places = np.flatnonzero(found[ends[i] - n[i] : ends[i]]) + first[i]
            if len(places):
                out.append(_row(kind, int(g[i]), places))
    return pa.Table.from_pylist(out, schema=ROW)


def equal_groups(data: np.ndarray, starts: np.ndarray, length: int, digit: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(rows, groups): the suffixes of data at starts that share their first `length` bytes with another, and a number for each set of equal ones.

    A most-significant-digit radix sort through `length` bytes: each pass orders what is left by (group, next `digit` bytes), cuts groups where
    the bytes differ, and leaves out suffixes that are alone. What is equal after the last pass is equal byte by byte.
    """
    number = np.zeros(len(data), np.uint32)  # the digit at each place, most significant byte first
    padded = np.concatenate([data, np.zeros(digit, np.uint8)])
    for k in range(digit):
        number = (number << np.uint32(8)) | padded[k : k + len(data)]
    rows, groups = np.arange(len(starts), dtype=np.int32), np.zeros(len(starts), np.uint32)
    for at in range(0, length, digit):
        value = number[starts[rows] + at]
        if at + digit > length:
            value >>= np.uint32(8 * (at + digit - length))
        key = (groups.astype(np.uint64) << np.uint64(32)) | value
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
        alone = new & np.concatenate([new[1:], [True]]) if len(key) else new
        rows, groups = rows[~alone], (new.cumsum(dtype=np.uint32) - np.uint32(1))[~alone]
    return rows, groups


def _judge_windows(table: pa.Table, length: int) -> pa.Table:
    """Of each group's contexts in a bucket, the (place, window) pairs whose window starts in a lesser document elsewhere."""
    parts, docs, places, counts, ends = [], [], [], [], []
    zstd = zstandard.ZstdDecompressor()
    for run, data, n, first in zip(*(table.column(c).to_pylist() for c in ("run", "data", "n", "first")), strict=True):
        _, doc, size = _columns(run, n)
        parts.append(zstd.decompress(data))
        docs.append(doc.view(np.int64))
        places.append(np.arange(n) + first)
        counts.append(size.astype(np.int64) - length + 1)
        ends.append(int(counts[-1].sum()))
    per, places, docs = np.concatenate(counts), np.concatenate(places), np.concatenate(docs)
    context = np.repeat(np.arange(len(per), dtype=np.int32), per)
    # a context of n windows has n + length - 1 bytes, so its windows start length - 1 bytes further on for each context before
    starts = np.arange(len(context), dtype=np.int32) + context * np.int32(length - 1)
    rows, groups = equal_groups(np.frombuffer(b"".join(parts), np.uint8), starts, length)
    del parts, starts
    ids = docs[context[rows]]
    least = np.minimum.reduceat(ids, np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))) if len(ids) else ids
    hit = np.sort(rows[ids > np.repeat(least, np.unique(groups, return_counts=True)[1])])
    start = per.cumsum() - per
    g, cuts = table.column("g").to_pylist(), np.searchsorted(hit, np.concatenate([[0], np.cumsum(ends)]))
    out = [_row(WINDOWS, g[i], places[context[at]], at - start[context[at]]) for i in range(len(g)) if len(at := hit[cuts[i] : cuts[i + 1]])]
    return pa.Table.from_pylist(out, schema=ROW)


def _distinct_windows(data: bytes, low: np.ndarray, high: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows that start at low to high: (starts, the id of each, the place of each among the distinct, a first row for each distinct, its least id)."""
    per = high - low + 1
    starts = np.repeat(low - (per.cumsum() - per), per) + np.arange(per.sum())
    owner = np.repeat(ids, per)
    rows = np.zeros((len(starts), -(-length // 8) * 8), np.uint8)
    rows[:, :length] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[starts]
    first, of, least = _distinct(*rows.view(np.uint64).T, doc=owner)
    return starts, owner, of, first, least


def _read(table: pa.Table, kind: int, columns: int) -> list[np.ndarray]:
    """The columns of all rows of a kind, as signed numbers."""
    rows = table.filter(pa.compute.equal(table.column("kind"), kind))
    parts = [_columns(r, n) for r, n in zip(rows.column("run").to_pylist(), rows.column("n").to_pylist(), strict=True)]
    return [np.concatenate([p[c].astype(np.int64) for p in parts]) if parts else np.zeros(0, np.int64) for c in range(columns)]


def _flags(size: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(size, dtype=bool)
    out[places] = True
    return out


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 3 << 20, bucket_bytes: int = 4 << 20, content: bool = True, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]), one per input row.

    Removes each byte covered by a string of `length` bytes that also starts in a document with a smaller id (an integer); matches do
    not cross documents, and are judged on the input. spans are the maximal removed byte ranges; kept is binary, since a range may end
    inside a character. Null and empty texts have no bytes; texts below `length` bytes lose nothing. Rows that share an id do not
    count against each other. A row with a null id has no order: it loses nothing and removes nothing. Other columns are ignored; an empty table gives no rows.

    Documents are dealt into groups of about group_bytes by hash of the id. A group sends each pair of digits once, with its least id, to
    the first digit's bucket (about bucket_bytes of text); a bucket answers with places in the group's own list. So what meets in a
    bucket for one string is at most one row per group, however often the string occurs, and all sizes follow the corpus.
    """
    bound_batches(docs)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, math.ceil(size / group_bytes))
    buckets = max(32, 1 << math.ceil(math.log2(max(1, size / bucket_bytes))))
    named = source.filter("doc_id IS NOT NULL").select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), "doc_id", "text")
    dealt = named.mapInArrow(_packed_texts, "g int, ids array<long>, sizes array<long>, data binary")

    def digits(table: pa.Table) -> pa.Table:
        group = Group.of(table)
        s = sampled_suffixes(group.data, group.starts, length)
        first, _, least = _distinct(s.gram, s.rest, doc=group.ids[s.doc])
        return pa.Table.from_pylist(_sent(DIGITS, table.column("g")[0].as_py(), buckets, s.gram[first], s.rest[first], least.view(np.uint64), s.sides[first]), schema=ROW)

    def contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ROW.empty_table()
        group, g = Group.of(table), table.column("g")[0].as_py()
        s = sampled_suffixes(group.data, group.starts, length)
        ids = group.ids[s.doc]
        first, of, least = _distinct(s.gram, s.rest, doc=ids)
        repeated = _flags(len(first), _read(answers, REPEATED, 1)[0])[of] | (ids > least[of])
        out = [_row(INTERVALS, g, s.low[repeated], s.high[repeated] + length - s.low[repeated])] if repeated.any() else []
        several, before, after = (_flags(len(first), _read(answers, kind, 1)[0]) for kind in (SEVERAL, BEFORE, AFTER))
        open_, alone = ~repeated & several[of], ~repeated & (before | after)[of]
        chosen = np.flatnonzero(several & _flags(len(first), of[open_]))
        dealt_by, owner, texts = [s.gram[first[chosen]]], [least[chosen]], [group.data[a : b + length] for a, b in zip(s.low[first[chosen]].tolist(), s.high[first[chosen]].tolist(), strict=True)]
        places, number = [s.low[open_]], [np.searchsorted(chosen, of[open_])]
        if alone.any():
            # single windows that hold a side shared with others, each a context of its own, dealt by a hash of all its bytes
            low = np.where(before[of], s.low, np.maximum(s.low, s.place + GRAM + _half(length) - length))
            high = np.where(after[of], s.high, np.minimum(s.high, s.place - _half(length)))
            at, mine, same, one, lesser = _distinct_windows(group.data, low[alone], high[alone], ids[alone], length)
            again = mine > lesser[same]
            if again.any():
                out.append(_row(INTERVALS, g, at[again], np.full(int(again.sum()), length)))
            windows = [group.data[a : a + length] for a in at[one].tolist()]
            dealt_by.append(np.fromiter(map(xxhash.xxh3_64_intdigest, windows), np.uint64, len(windows)) >> np.uint64(16))
            owner.append(lesser)
            texts += windows
            places.append(at[~again])
            number.append(same[~again] + len(chosen))
        if texts:
            keys = np.concatenate(dealt_by)
            order = np.argsort(keys, kind="stable")
            texts = [texts[i] for i in order.tolist()]
            out += _sent(CONTEXTS, g, 4 * buckets, keys[order], np.concatenate(owner)[order].view(np.uint64), np.array([len(t) for t in texts], dtype=np.uint64), texts=texts)
            if sum(map(len, places)):
                out.append(_row(PLACES, g, np.concatenate(places), np.argsort(order)[np.concatenate(number)]))
        return pa.Table.from_pylist(out, schema=ROW)

    def result(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        group = Group.of(table)
        marks = np.zeros(len(group.data) + 1, dtype=np.int32)
        at, span = _read(found, INTERVALS, 2)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + span, -1)
        low, which = _read(found, PLACES, 2)
        context, offset = _read(found, WINDOWS, 2)
        if len(low) and len(context):
            order = np.argsort(which, kind="stable")
            left, right = np.searchsorted(which[order], context, "left"), np.searchsorted(which[order], context, "right")
            times = right - left
            place = order[np.repeat(left - (times.cumsum() - times), times) + np.arange(times.sum())]
            at = low[place] + np.repeat(offset, times)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + length, -1)
        gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
        out = []
        for i, t in enumerate(group.texts):
            part = gone[group.starts[i] : group.starts[i + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))).reshape(-1, 2) if part.any() else np.zeros((0, 2), np.int64)
            kept = np.frombuffer(t, np.uint8)[~part].tobytes() if len(edges) else t
            row = {"doc_id": int(group.ids[i]), "n_bytes": len(t), "n_removed": len(t) - len(kept), "n_spans": len(edges), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | ({"spans": [{"start": int(a), "end": int(b)} for a, b in edges], "kept": kept} if content else {}))
        return pa.Table.from_pylist(out, schema=schema)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if content:
        fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
        ddl += f", spans {SPANS}, kept binary"
    schema = pa.schema(fields)

    sent = dealt.groupBy("g").applyInArrow(digits, ROW_DDL)
    answers = sent.groupBy("bucket").applyInArrow(lambda t: _judge_digits(t, hot), ROW_DDL)
    found = materialise(dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(contexts, ROW_DDL), "suffix-contexts")
    more = found.filter(F.col("kind") == CONTEXTS).groupBy("bucket").applyInArrow(lambda t: _judge_windows(t, length), ROW_DDL)
    columns = ["kind", "g", "n", "run"]
    local = found.filter(F.col("kind").isin(INTERVALS, PLACES)).select(columns).unionByName(more.select(columns))
    ordered = dealt.groupBy("g").cogroup(local.groupBy("g")).applyInArrow(result, ddl)
    whole = F.coalesce("text", F.lit(""))
    extra = [F.expr(f"CAST(array() AS {SPANS}) AS spans"), whole.cast("binary").alias("kept")] if content else []
    no_order = source.filter("doc_id IS NULL").select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole.cast("binary"), 256).alias("kept_sha256"), *extra)
    return ordered.unionByName(no_order)
