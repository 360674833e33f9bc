"""WARC archives: writing, normalising of monolithic gzip files, and reading by offset.

`write` makes one archive for each task, compressed as a single gzip stream, as careless crawlers leave them. `normalise`
inflates such a stream once, front to back, rewrites every record as a gzip member of its own and writes a sidecar index
(one row for each record: file, offset, length) as Parquet. `read` fetches records by the index.

Files lie in the shared folder and are opened through pyarrow's file systems, so any store with a URI serves. A file is
written under the attempt's own name and then moved: a repeated task leaves the same file.

Of records with equal payloads of at least `MIN_REVISIT` bytes that with the largest page_id is the response and the
others revisit it. Defined results: null html is the empty payload; equal payloads whose page_ids tie at the largest
are all responses; a null page_id never is the largest unless all are null, when all are responses. Null urls are
written as the empty target. Records hold whole payloads of any length. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path
from .wordbytes import parts

MIN_REVISIT = 1000
#: revisited digests up to this many (of 50 bytes) are broadcast, else joined
BROADCAST_ROWS = 100_000
BLOCK = 1 << 20
LEVEL = 4
INDEX = "file string, offset long, length long, record_id string"


class _Move:
    """A file in a store that appears under its name only when complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.own, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with payload (binary), payload_digest, record_type and refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("large", F.octet_length("payload") >= min_revisit)
    copies = rows.filter("large").groupBy("payload_digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "newest")
    copies = copies.persist()
    n = copies.count()
    joined = rows.join(F.broadcast(copies) if n <= BROADCAST_ROWS else copies, "payload_digest", "left")
    revisit = F.col("large") & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit carries no payload but its length and digest."""
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def write(planned: DataFrame, folder: str) -> DataFrame:
    """One single-stream gzip archive for each task; returns (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, n = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        for batch in parts(batches, 500):
            for r in batch.to_pylist():
                if out is None:
                    out = _Move(uri)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.out.write(z.compress(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"])))
                n += 1
        if out is not None:
            out.out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["file", "records"])

    return planned.mapInArrow(run, "file string, records long")


def _inflate(uri: str) -> Iterator[bytes]:
    """The stream's content in blocks; also of files that have several members."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z = zlib.decompressobj(31)
        while block := f.read(BLOCK):
            while block:
                yield z.decompress(block)
                block = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)
                    block = block.lstrip(b"\0")
        yield z.flush()


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, body, the whole record) of a WARC stream, one at a time."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            block = next(stream, None)
            if block is None:
                return False
            held.extend(block)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head = parse_head(bytes(held[:end]))
        total = end + 4 + int(head["content-length"]) + 4
        if not fill(total):
            raise ValueError("the archive ends within a record")
        whole = bytes(held[:total])
        del held[:total]
        yield head, whole[end + 4 : total - 4], whole


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member for each record; returns the index (file, offset, length, record_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                target = f"{folder}/{uri.rpartition('/')[2].replace('mono-', 'norm-')}"
                out, at, rows = _Move(target), 0, []
                for head, _, whole in records(_inflate(uri)):
                    member = gzip.compress(whole, LEVEL, mtime=0)
                    out.out.write(member)
                    rows.append((target, at, len(member), head.get("warc-record-id", "")))
                    at += len(member)
                out.close()
                cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["file", "offset", "length", "record_id"])

    return files.mapInArrow(run, INDEX)


def read(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits), by the index.

    The digest and length of a response are taken from what its member inflates to, those of a revisit from its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for uri, own in groupby(rows, lambda r: r[0]):
                fs, path = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    held, size = [], 0
                    for _, offset, length in own:
                        f.seek(offset)
                        whole = gzip.GzipFile(fileobj=io.BytesIO(f.read(length))).read()
                        held.append(_parsed(whole))
                        size += len(whole)
                        if size > 8 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    return index.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _parsed(whole: bytes) -> tuple:
    end = whole.index(b"\r\n\r\n")
    head = parse_head(whole[:end])
    body = whole[end + 4 : -4]
    number = lambda s: None if s in (None, "null") else int(s)
    page = number(head["warc-record-id"].strip("<>").rpartition(":")[2])
    if head["warc-type"] == "revisit":
        return page, head["warc-target-uri"], int(head["x-payload-length"]), head["warc-payload-digest"].partition(":")[2], "revisit", number(head["warc-refers-to"].strip("<>").rpartition(":")[2]), None
    return page, head["warc-target-uri"], len(body), hashlib.sha1(body).hexdigest(), "response", None, body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives, and read the records back by the sidecar index."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    files = write(plan(pages), folder)
    files.write.parquet(f"{folder}/files")
    files = spark.read.schema(files.schema).parquet(f"{folder}/files")
    n = max(1, files.count())
    index = normalise(files.repartition(n), folder)
    index.write.parquet(f"{folder}/index")
    return read(spark.read.schema(INDEX).parquet(f"{folder}/index"))
