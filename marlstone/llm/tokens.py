"""Token ids in seekable files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file is one stream of little-endian unsigned 32-bit ids, cut into frames of equal size. After the frames comes a skippable frame
that holds (compressed size, size, checksum) for each, the number of frames, a descriptor and a magic number: the published
zstandard seekable format, so any zstandard reader can also read the whole stream.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, bound_batches, materialise, scratch, text_slices

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80
#: What is cut off the end of a word before its ids are looked up.
STOPS = b".,;:!?"
#: Words of small letters of ASCII and Latin-1, in composed form.
SMALL_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class FrameWriter:
    """Appends bytes to one file, in frames of frame_bytes."""

    def __init__(self, uri: str, frame_bytes: int = 256 << 10, level: int = 3) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.frame_bytes, self.pending, self.size, self.table = fs.open_output_stream(path, compression=None), frame_bytes, bytearray(), 0, []
        self.zstd = zstandard.ZstdCompressor(level=level)

    def write(self, data: bytes) -> int:
        """Append; returns the offset in the stream at which data starts."""
        at = self.size
        self.size += len(data)
        self.pending += data
        while len(self.pending) >= self.frame_bytes:
            self._frame(bytes(self.pending[: self.frame_bytes]))
            del self.pending[: self.frame_bytes]
        return at

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE_MAGIC))
        self.out.close()


class FrameReader:
    """Reads byte ranges of the stream; decompresses only the frames that a range touches, and checks them."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not descriptor & HAS_CHECKSUM:
            raise ValueError(f"{uri} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = np.concatenate([[0], table[:, 0].cumsum()]), np.concatenate([[0], table[:, 1].cumsum()]), table[:, 2]
        self.zstd, self.last, self.uri, self.frames_read = zstandard.ZstdDecompressor(), (-1, b""), uri, 0

    def _frame(self, i: int) -> bytes:
        if self.last[0] != i:
            size = int(self.plain[i + 1] - self.plain[i])
            data = self.zstd.decompress(self.file.read_at(int(self.packed[i + 1] - self.packed[i]), int(self.packed[i])), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i} of {self.uri} does not match its checksum")
            self.last, self.frames_read = (i, data), self.frames_read + 1
        return self.last[1]

    def read(self, start: int, size: int) -> bytes:
        parts, i, end = [], int(np.searchsorted(self.plain, start, "right")) - 1, start + size
        while start < end:
            data = self._frame(i)[start - int(self.plain[i]) : end - int(self.plain[i])]
            parts.append(data)
            start, i = start + len(data), i + 1
        return b"".join(parts)


@lru_cache(maxsize=4)
def _encoder(path: str, cache_words: int) -> WordEncoder:
    return WordEncoder(path, cache_words)


#: Normaliser and pre-tokeniser of the files whose texts may be cut at white space (fixed values of `word_bpe_49k`).
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


def wordwise(path: str) -> bool:
    """Whether a tokenizer file says that it drops white space, folds case and merges neither across white space nor from a letter or digit into a stop."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    return all(stated.get(k) == v for k, v in WORDWISE.items()) and not any(len(t["content"].split()) != 1 or t.get("lstrip") or t.get("rstrip") for t in stated.get("added_tokens") or [])


class WordEncoder(dict):
    """Ids of pieces between ASCII white space, as little-endian bytes; a dictionary that works out what it lacks.

    Texts are cut at white space if the tokenizer file allows it (see wordwise); by any other tokenizer each is encoded whole by the library. A new piece is cut into a core and the stops that end it, and a core of ASCII letters is folded, so that
    the library sees each word once. A core of small letters, which normalisation and pre-tokenisation leave in one part, goes straight
    to the library's merge model; anything else takes the whole way. Two generations of cache_words entries bound the memory.
    """

    def __init__(self, path: str, cache_words: int = 400_000) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self.by_words = wordwise(path)
        self.merge, self.old = self.tokenizer.model.tokenize, {}
        tried = [b"the", b"tion", b"ndering", "für".encode(), "éçàêœ"[:4].encode(), "straße".encode()]
        self.direct = self.by_words and all(self._merged(w) == self._whole(w) for w in tried)

    def _whole(self, core: bytes) -> bytes:
        ids = self.tokenizer.encode(core.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, core: bytes) -> bytes:
        ids = [t.id for t in self.merge(core.decode("latin-1").translate(BYTE_CHARS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def parts(piece: bytes) -> tuple[bytes, bytes]:
        """The core, folded where that is safe (no special token, nothing that could compose), and the stops after it."""
        core = piece.rstrip(STOPS)
        if not core[-1:].isalnum():
            core = piece
        tail = piece[len(core) :]
        return (core.lower() if core.isascii() and b"<" not in core else core), tail

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            core, tail = self.parts(piece)
            if core != piece:
                ids = self[core] + (self[tail] if tail else b"")
            else:
                ids = self._merged(core) if self.direct and SMALL_LETTERS(core) else self._whole(core)
        self[piece] = ids
        return ids

    def encode_batch(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        if not self.by_words:
            return [self._whole(t) + end if t else end for t in texts]
        if len(self) > self.cache_words:
            self.old = dict(self)
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.split())) + end if t else end for t in texts]


def write_tokens(docs: DataFrame, tokenizer: str, uri: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", order: list[Column] | None = None, frame_bytes: int = 256 << 10, cache_words: int = 400_000) -> DataFrame:
    """Encode every text and write the ids to files under uri; returns the index: (doc_id, part, seq, file, at, n_tokens).

    Documents are dealt to files by ranges of `order` (by default the id, nulls first; equal ids by text) and stand in that order
    in each; part is the place of the file, seq that in the file, at the byte offset in the file's stream. A null text is
    empty; each document ends with end_id. Repeated rows are written again; other columns are ignored; an empty table writes no
    file. A task that is run again writes a file of another name, and the index, which is written last, names only those that count.
    """
    spark = docs.sparkSession
    base = uri or scratch(spark, "tokens")
    bound_batches(docs)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[c.alias(f"_o{i}") for i, c in enumerate(order or [])], F.col(f"`{text}`").cast("string").alias("text"))
    keys = [f"_o{i}" for i in range(len(order or []))] or ["doc_id"]
    dealt = source.repartitionByRange(*keys).sortWithinPartitions(*dict.fromkeys([*keys, "doc_id", "text"])).select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seq, part = None, 0, TaskContext.get().partitionId()
        encoder = _encoder(tokenizer, cache_words)
        name = f"{base}/{part:06d}-{uuid.uuid4().hex}.zst"
        for rows in text_slices(batches):
            writer = writer or FrameWriter(name, frame_bytes)
            coded = encoder.encode_batch(as_bytes(rows.column(1)), end)
            at = [writer.write(c) for c in coded]
            n = len(coded)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array([name] * n), pa.array(at, pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64())], ["doc_id", "part", "seq", "file", "at", "n_tokens"])
            seq += n
        if writer:
            writer.close()

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, part int, seq long, file string, at long, n_tokens long"
    return materialise(dealt.mapInArrow(run, schema), "tokens-index")


def starts(index: DataFrame) -> DataFrame:
    """The index with start, the number of ids before each document: offsets of whole files (one row a file) and places within them."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    files = files.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return index.join(files, "part").withColumn("start", F.col("before") + (F.col("at") / 4).cast("long")).drop("before")


def read_tokens(index: DataFrame, ids: bool = True, chunk_bytes: int = 8 << 20) -> DataFrame:
    """The index rows given, with ids_crc32 and (if asked for) ids, read back from the files; only their frames are decompressed.

    Rows are dealt by (file, chunk of chunk_bytes of its stream) to tasks of four chunks or so (one for each core at least), and read in order of place.
    """
    names = index.columns
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-4 * (index.agg(F.sum("n_tokens")).first()[0] or 0) // (4 * chunk_bytes)))
    index = index.repartition(tasks, F.col("file"), F.floor(F.col("at") / chunk_bytes)).sortWithinPartitions("file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for cut in range(0, batch.num_rows, 512):
                rows = batch.slice(cut, 512)
                data = []
                for file, at, n in zip(*(rows.column(names.index(c)).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                    if reader is None or reader.uri != file:
                        reader = FrameReader(file)
                    data.append(reader.read(at, 4 * n))
                more = [pa.array([zlib.crc32(d) for d in data], pa.int64())]
                if ids:
                    more.append(pa.array([np.frombuffer(d, "<u4").astype(np.int64) for d in data], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*names, "ids_crc32", *["ids"] * ids])

    return index.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", ids_crc32 long" + ", ids array<long>" * ids)
