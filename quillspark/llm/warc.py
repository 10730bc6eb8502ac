"""WARC archives as a chunked record table.

An archive is a run of gzip members, one a record, as in a .warc.gz file; it is kept as rows (archive, record, block_no, data) of
bounded size. A record's header, payload and trailer are compressed as a stream and leave the writer block by block, and the
reader takes the blocks of a record in order, inflates a bounded piece at a time, parses the header when it is whole, and gives
the payload as rows (archive, record, chunk_no, payload) with the SHA-1 so far: neither side builds a whole record.

Of records with equal payloads of at least 1000 bytes the one with the largest page id is the response, the others are revisits
that refer to it. Equal payloads meet by digest in an aggregation (one row a digest and task, however many copies); what comes back is a lookup of digests
that occur twice or more. The reader takes a revisit's digest and length from its header: there is no payload to hold against them.

Defined results. A null payload is empty. A null url is written without a target. Repeated page ids: each row gets a record (rows
with the largest id of equal payloads are all responses). A null page id is always a response and none refers to it. An empty table
gives no archive rows and no pages. A record cut short, and one whose payload has not the length or digest of its header, raises
when read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, to_arrow, written

CHUNK = 1 << 18
LEAST = 1000
BLOCKS = "archive int, record long, block_no int, data binary"
CHUNKS = "archive int, record long, chunk_no int, page_id long, record_type string, refers_to long, url string, payload binary, digest_so_far string, payload_bytes long, last boolean, digest_ok boolean"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the response's page id for revisits, else null."""
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # payloads too short for a revisit meet no others: each has a key of its own, so the many empty ones are not one key
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("short:"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a lookup by digest: payloads stay where they are while few digests repeat; beyond that, rows of one digest are dealt over salts
    rows = sized_join(rows, written(first.withColumnRenamed("digest", "same"), "warc-repeated"), ["same"], max_rows=500_000)
    return rows.withColumn("refers_to", F.when(F.col("kept") != F.col("page_id"), F.col("kept"))).drop("kept", "same")


def header(page_id: int | None, url: str | None, n: int, digest: str, refers_to: int | None, stored: int) -> bytes:
    """A WARC/1.1 record header."""
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {stored}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def deflated(parts: Iterator[bytes], block: int) -> Iterator[bytes]:
    """One gzip member of the parts, in blocks."""
    z, held = zlib.compressobj(6, zlib.DEFLATED, 31), bytearray()
    for p in parts:
        held += z.compress(p)
        while len(held) >= block:
            yield bytes(held[:block])
            del held[:block]
    held += z.flush()
    for a in range(0, len(held), block):
        yield bytes(held[a : a + block])


def write_archives(pages: DataFrame, archives: int = 64, block: int = CHUNK, **names) -> DataFrame:
    """The archives of a page table, written to the shared folder: BLOCKS rows."""
    rows = records(pages, **names).withColumn("archive", F.pmod(F.xxhash64("page_id"), F.lit(archives)).cast("int"))
    shape = to_arrow(BLOCKS, pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[tuple] = []
            held = 0
            for page_id, url, payload, digest, refers_to, archive in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "archive"))):
                body, refers_to = memoryview(payload.as_buffer()), refers_to.as_py()
                n = len(body)
                body = body if refers_to is None else body[:0]  # a revisit has no payload of its own
                head = header(page_id.as_py(), url.as_py(), n, digest.as_py(), refers_to, len(body))
                parts = (x for y in ((head,), (body[a : a + block] for a in range(0, len(body), block)), (b"\r\n\r\n",)) for x in y)
                for k, data in enumerate(deflated(parts, block)):
                    out.append((archive.as_py(), (task << 40) + count, k, data))
                    held += len(data)
                    if held > 16 * block:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), shape)], schema=shape)
                        out, held = [], 0
                count += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return written(rows.mapInArrow(run, BLOCKS), "warc")


class Record:
    """Takes the blocks of one record in order and gives payload chunks."""

    def __init__(self, archive: int, record: int, chunk: int):
        self.key, self.chunk = (archive, record), chunk
        self.z, self.fields, self.held, self.sha, self.seen, self.no, self.done = zlib.decompressobj(31), None, bytearray(), hashlib.sha1(), 0, 0, False

    def _row(self, data: bytes, last: bool) -> tuple:
        self.sha.update(data)
        f, self.no, self.done = self.fields, self.no + 1, last
        page, refers = (f.get(k, "")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        if last and f["warc-type"] != "revisit" and (self.sha.hexdigest() != digest or self.seen != int(f["x-payload-length"])):
            raise ValueError(f"record {self.key} is damaged: its payload is not what its header says")
        ok = True if last else None
        return (*self.key, self.no - 1, int(page) if page else None, f["warc-type"], int(refers) if refers else None, f.get("warc-target-uri"), data, digest if f["warc-type"] == "revisit" else self.sha.hexdigest(), int(f["x-payload-length"]), last, ok)

    def _take(self) -> Iterator[tuple]:
        if self.fields is None:
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.held[:end]).decode().split("\r\n")
            self.fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            self.size = int(self.fields["content-length"])
            del self.held[: end + 4]
        while not self.done:
            n = min(self.chunk, self.size - self.seen)
            if len(self.held) < n:
                return
            data = bytes(self.held[:n])
            del self.held[:n]
            self.seen += n
            yield self._row(data, self.seen == self.size)

    def feed(self, data: bytes) -> Iterator[tuple]:
        while data:
            self.held += self.z.decompress(data, self.chunk)
            data = self.z.unconsumed_tail
            yield from self._take()

    def close(self) -> Iterator[tuple]:
        self.held += self.z.flush()
        yield from self._take()
        if not self.done or not self.z.eof:
            raise ValueError(f"record {self.key} is cut short")


def read_archives(blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS rows of archives: a record with an empty payload gives one empty chunk. digest_ok is set on the last chunk."""
    shape = to_arrow(CHUNKS, blocks.sparkSession)

    def run(batches):
        now, out, held = None, [], 0

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

        for b in batches:
            for archive, record, data in zip(b.column("archive").to_pylist(), b.column("record").to_pylist(), b.column("data")):
                rows: list[tuple] = []
                if now is None or now.key != (archive, record):
                    rows += now.close() if now else ()
                    now = Record(archive, record, chunk)
                for row in (y for x in (rows, now.feed(data.as_py())) for y in x):
                    out.append(row)
                    held += len(row[7])
                    if held > 16 * chunk or len(out) >= 2000:
                        yield batch(out)
                        out, held = [], 0
        if now:
            out += now.close()
        if out:
            yield batch(out)

    return blocks.repartition("archive", "record").sortWithinPartitions("archive", "record", "block_no").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Each page's record as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks, digest_ok."""
    last = read_archives(write_archives(pages, **names)).where("last")
    return last.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"), "digest_ok")
