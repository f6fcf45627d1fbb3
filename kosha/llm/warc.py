"""WARC archives: segmented writing, and reading with reassembly of segments.

Records are written as gzip members of files in a shared folder; blocks over a
size limit are cut into a first record and continuation records.  Reading streams
the files, groups continuation records by their origin's identifier, orders them
by segment number, verifies the total length and decodes chunked transfer
framing.  Records whose payload equals that of a response are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, keep, scratch

SEGMENT = 2 * 1024  # bytes of a block in one record; few pages of a crawl are shorter
CHUNK = 16 * 1024  # bytes of a chunk of the transfer framing
FILE = 64 * 1024 * 1024  # a file of this many bytes is closed and the next begun
LEAST_REVISIT = 1000  # bytes of payload from which equal ones are revisits
NAMESPACE = uuid.UUID("6f1c0f0e-2f5b-4a55-9d3c-0d5a3f0b7f11")

_SAFE = "".join(map(chr, range(33, 127)))  # all printable ASCII stays as it is in a URI
PART = "origin string, number int, total long, id long, record_type string, refers_to long, digest string, body binary"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def _http(payload: bytes) -> bytes:
    """An HTTP message whose body is framed in chunks."""
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for i in range(0, len(payload), CHUNK):
        part = payload[i : i + CHUNK]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; trailers and chunk extensions are skipped, a body cut short is an error."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[line + 2 : line + 2 + size]
        if len(part) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(part)
        at = line + 4 + size


def http_payload(message: bytes) -> bytes:
    """The body of an HTTP message, decoded if its headers say that it is chunked."""
    head, _, body = message.partition(b"\r\n\r\n")
    chunked = any(h.lower().startswith(b"transfer-encoding:") and b"chunked" in h.lower() for h in head.split(b"\r\n"))
    return dechunk(body) if chunked else body


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_records(key: str, page: int | None, url: str, kind: str, refers: int | None, digest: str, payload: bytes, segment: int):
    """The records of one page under the unique name key: a response, in segments if its block is long, or a revisit without payload."""
    origin = record_id(key)
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Record-ID", origin), ("WARC-Target-URI", quote(url, safe=_SAFE)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", sha1)]
    common += [("X-Page-ID", str(page))] if page is not None else []
    if kind == "revisit":
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), *common, profile, ("X-Refers-To-Page", str(refers))], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = _http(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    kinds = ("Content-Type", "application/http;msgtype=response")
    yield _record([("WARC-Type", "response"), *common, kinds, *([("WARC-Segment-Number", "1")] if len(parts) > 1 else [])], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{key}/{k}")), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(k)), *last], part)


def _plain(stream, size: int = 1 << 20):
    """The bytes of a stream of gzip members, or of a plain one, piece by piece."""
    packer = None
    while raw := stream.read(size):
        while raw:
            if packer is None and raw[:1] != b"\x1f":
                yield raw
                break
            packer = packer or zlib.decompressobj(31)
            yield packer.decompress(raw)
            raw, packer = packer.unused_data, None if packer.eof else packer


def read_records(stream):
    """(headers, block) of every record of a stream; one record at a time is in memory."""
    pieces, data = _plain(stream), bytearray()
    while True:
        while (need := _need(data)) is None or len(data) < need:
            piece = next(pieces, None)
            if piece is None:
                if data:
                    raise ValueError("record cut short")
                return
            data += piece
        head, _, _ = bytes(data[:need]).partition(b"\r\n\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        yield headers, bytes(data[len(head) + 4 : need - 4])
        del data[:need]


def _need(plain: bytearray) -> int | None:
    """Bytes of the first record with its closing line ends, once its headers are there."""
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    for line in bytes(plain[:end]).split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            return end + 4 + int(line.split(b":")[1]) + 4
    raise ValueError("record without length")


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """id, url, payload, digest, record_type and refers_to of every page.

    Of pages with equal payloads of at least `least` bytes, the one with the
    largest id is the response and the others revisit it.  Equality is that of
    SHA-1 digests and lengths.  Hot payloads are aggregated before they are
    shuffled, and only digests are.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    first = keep(first.select(F.col("digest").alias("d2"), F.col("n").alias("n2"), "top"), "repeated-payloads")
    joined = rows.join(broadcast_if_small(first), F.expr("digest = d2 AND n = n2"), "left")
    return joined.select("id", "url", "payload", "digest", F.when(F.expr("top <> id"), "revisit").otherwise("response").alias("record_type"), F.expr("CASE WHEN top <> id THEN top END").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Write one archive or more for each partition of classified pages; return the manifest (path, records).

    Each attempt of a task writes files of its own names; only those whose task
    ended well are in the manifest, so a retried or speculative task leaves no
    doubles.  The manifest is kept as a table.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem, n, k, out, done, records = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, 0, None, [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page, url, payload, digest, kind, refers = (x.as_py() for x in row)
                n += 1
                for x in page_records(f"{stem}/{n}", page, url, kind, refers, digest, payload, segment):
                    if out is None:
                        path = f"{stem}-{k:04d}.warc.gz"
                        out, records, k = store.open_output_stream(path, compression=None), 0, k + 1
                    out.write(x)
                    records += 1
                if out is not None and out.tell() >= FILE:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        yield pa.RecordBatch.from_pydict({"path": pa.array([scheme + p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return keep(pages.select("id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "path string, records long"), "warc-manifest")


def read_parts(paths: DataFrame) -> DataFrame:
    """Every response, revisit and continuation record of the archives named in column path."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for h, block in read_records(stream):
                        kind = h["warc-type"]
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        digest = h.get("warc-payload-digest", "").partition(":")[2]
                        rows.append(
                            {
                                "origin": h.get("warc-segment-origin-id", h["warc-record-id"]),
                                "number": int(h.get("warc-segment-number", 0)),
                                "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                                "id": int(h["x-page-id"]) if "x-page-id" in h else None,
                                "record_type": kind,
                                "refers_to": int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None,
                                "digest": base64.b32decode(digest).hex() if digest else None,
                                "body": block,
                            }
                        )
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_PART)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_PART)

    return paths.select("path").mapInArrow(run, PART)


_PART = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("body", pa.binary())])


def reassemble(parts: DataFrame) -> DataFrame:
    """id, record_type, refers_to, payload_digest and payload of whole records, one for each origin.

    The parts of an origin are ordered by segment number, their numbers and total
    length verified, the blocks joined and chunked framing decoded.  A segmented
    record whose numbers are not 1 to n, or whose length is not the total, raises,
    as does a payload that differs from its digest.
    """
    groups = parts.groupBy("origin").agg(
        F.max("id").alias("id"),
        F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"),
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("number", "body"))).alias("s"),
    )
    numbers, bodies = F.transform("s", lambda x: x["number"]), F.transform("s", lambda x: x["body"])
    return _payloads(groups.select("origin", "id", "record_type", "refers_to", "digest", "total", numbers.alias("numbers"), bodies.alias("bodies")))


def _payloads(records: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("origin", "id", "record_type", "refers_to", "digest", "total", "numbers")}
            payloads = []
            for origin, kind, digest, total, numbers, bodies in zip(*(columns[c] for c in ("origin", "record_type", "digest", "total", "numbers")), batch.column("bodies"), strict=True):
                block = b"".join(x.as_buffer() for x in bodies)
                if numbers != [0] and (kind is None or numbers != list(range(1, len(numbers) + 1)) or len(block) != total):
                    raise ValueError(f"segments missing of {origin}")
                payloads.append(None if kind == "revisit" else http_payload(block))
                if kind == "response" and digest and hashlib.sha1(payloads[-1]).hexdigest() != digest:
                    raise ValueError(f"payload of {origin} differs from its digest")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "record_type", "refers_to", "digest")), pa.array(payloads, pa.binary())], names=["id", "record_type", "refers_to", "payload_digest", "payload"])

    return records.mapInArrow(run, "id long, record_type string, refers_to long, payload_digest string, payload binary")


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Write pages (page_id, url, html) to archives and read them back.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to.
    Revisits take digest and length from the response they refer to.  Null html
    is an empty payload, null urls are empty; repeated ids, if any, keep one
    record each, told apart by nothing but their place.  An empty table writes
    nothing and gives an empty result.  Other columns play no part.
    """
    folder = folder or scratch(spark) + "/warc"
    manifest = write_archives(classify(pages), folder, segment)
    records = reassemble(read_parts(manifest.repartition(spark.sparkContext.defaultParallelism * 2)))
    records = keep(records.select("id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("bytes")), "records")
    sizes = records.where("record_type = 'response'").groupBy(F.col("id").alias("of")).agg(F.max("bytes").alias("of_bytes"))
    return records.join(sizes, F.col("refers_to") == F.col("of"), "left").select(F.col("id").alias("page_id"), F.coalesce("of_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
