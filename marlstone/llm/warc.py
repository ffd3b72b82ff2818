"""WARC archives: one record per page, an index of records, and coalesced byte-range reads of the records selected."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialise, scratch, text_slices

INDEX = "file string, offset long, length long, url string, digest string, page_id {id}, record_type string"


def _digest_header(hexadecimal: str) -> str:
    """sha1:BASE32, as archives state it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _digest_of(header: str) -> str:
    return base64.b32decode(header.removeprefix("sha1:")).hex()


def record(page_id: object, url: str | None, kind: str, digest: str, payload: bytes | None, size: int, refers_to: object = None) -> bytes:
    """One WARC/1.1 record. Its block is an HTTP response: header, then the payload (a revisit has the header alone)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        # line ends and other control characters would break the header
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: {_digest_header(digest)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The headers of one record, its payload (None for a revisit) and the payload's stated size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not at the start of a record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = headers["WARC-Type"]
    if kind != "revisit" and len(payload) != size:
        raise ValueError("a record is cut short")
    return {"record_type": kind, "page_id": headers["WARC-Record-ID"][10:-1], "refers_to": headers.get("WARC-Refers-To", "<urn:page:>")[10:-1] or None, "url": headers.get("WARC-Target-URI"), "size": size, "digest": _digest_of(headers["WARC-Payload-Digest"]), "payload": None if kind == "revisit" else payload}


def write_warc(pages: DataFrame, uri: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, file_bytes: int = 256 << 20, most_broadcast: int = 200_000) -> DataFrame:
    """Write a record per page under uri; returns the index: (file, offset, length, url, digest, page_id, record_type).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads (by SHA-1, size and a second hash) of at least
    least_bytes, that with the largest id is a response and the others revisit it; smaller ones are responses. Rows that repeat the largest
    id are responses each; a null id is never the largest, unless it is the only one. A null url has no target header. Other columns are ignored; an empty table writes no file.

    Each record is a gzip member of its own, so it can be read alone. Only payload hashes are grouped. Up to most_broadcast repeated payloads (about
    150 bytes each, counted first) are broadcast, and pages stay where they are; beyond, they are joined by their hashes, and adaptive execution splits hot ones. A
    task starts a new file every file_bytes; a task that runs again writes other files, and the index names those that count.
    """
    base = uri or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html"), "check": F.xxhash64("html")})
    same = ["digest", "size", "check"]
    groups = materialise(rows.filter(F.col("size") >= least_bytes).groupBy(*same).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-repeated")
    judged = rows.join(F.broadcast(groups) if groups.count() <= most_broadcast else groups.hint("merge"), same, "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    judged = judged.select("page_id", "url", "digest", F.col("size").cast("long"), F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"), F.when(~revisit, F.col("html")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset, name = None, 0, ""
        for part in text_slices(batches):
            index: list[tuple] = []
            payloads = as_bytes(part.column(6))
            for i, (page, link, digest, size, refers, again) in enumerate(zip(*(part.column(c).to_pylist() for c in range(6)), strict=True)):
                if out is None or offset >= file_bytes:
                    if out:
                        out.close()
                    name, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, path = pafs.FileSystem.from_uri(name)
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                kind = "revisit" if again else "response"
                data = gzip.compress(record(page, link, kind, digest, payloads[i], size, refers), mtime=0)
                out.write(data)
                index.append((name, offset, len(data), link, digest, kind))
                offset += len(data)
            files, offsets, lengths, links, digests, kinds = map(list, zip(*index, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(links, pa.string()), pa.array(digests), part.column(0), pa.array(kinds)], ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out:
            out.close()

    return materialise(judged.mapInArrow(run, INDEX.format(id=rows.schema["page_id"].dataType.simpleString())), "warc-index")


def read_warc(index: DataFrame, chunk_bytes: int = 8 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the index rows given.

    Records are dealt by (file, chunk of chunk_bytes) to tasks of four chunks or so (one for each core at least), sorted by offset, and read in byte ranges that bridge gaps of up to gap_bytes. For a
    response, size and digest are taken from the bytes read (a digest other than its header's is an error); for a revisit from its
    headers, and payload is null. Ids come back as text. Index rows given twice are read twice; an empty index gives no rows.
    """
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-(index.agg(F.sum("length")).first()[0] or 0) // (4 * chunk_bytes)))
    dealt = index.select("file", F.floor(F.col("offset") / chunk_bytes).alias("chunk"), "offset", "length").repartition(tasks, "file", "chunk").sortWithinPartitions("file", "offset").drop("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(cut, 256).columns), strict=True))
                found, i = [], 0
                while i < len(rows):
                    file, start, size = rows[i]
                    end, j = start + size, i + 1
                    while j < len(rows) and rows[j][0] == file and rows[j][1] <= end + gap_bytes and rows[j][1] + rows[j][2] - start <= chunk_bytes:
                        end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                    if file != name:
                        fs, path = pafs.FileSystem.from_uri(file)
                        name, handle = file, fs.open_input_file(path)
                    data = handle.read_at(end - start, start)
                    found += [parse(gzip.decompress(data[o - start : o - start + n])) for _, o, n in rows[i:j]]
                    i = j
                for r in found:
                    if r["payload"] is not None and hashlib.sha1(r["payload"]).hexdigest() != r["digest"]:
                        raise ValueError(f"page {r['page_id']} does not match its digest")
                kinds = {"page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "size": pa.int64(), "digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in kinds.items()], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return dealt.mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
