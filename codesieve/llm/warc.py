"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of their id, sorted by id within a shard, and written as gzip members, one a
record, into files that roll over by their compressed size. Headers are made anew from the record: id, date, target,
length, SHA-1 block and payload digests. Of records with equal payloads the one with the smallest id is the response,
the others are revisits that refer to it. A file is written under a temporary name in the shared store and renamed when
it is complete; the manifest (file, records, bytes, digest) is itself a table that Spark commits only for tasks that
succeeded, and readers read the files of the manifest alone, so lost executors leave nothing behind that counts. The
same rows give the same bytes in the same files.

Nulls and odd rows: a null payload is written as an empty one and a null url as an empty target; records with a null id
come first, and are a group's response only if no record of an id has that payload; among repeated rows the first is
the response; further columns are ignored; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, shared_path
from .ranges import deal, range_bounds, shard_column

MANIFEST = "shard int, file string, n_records bigint, n_bytes bigint, sha256 string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records of one archive run bear one date, so that a rerun gives the same bytes.
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str, level: int) -> bytes:
    """A record as one gzip member."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block) if revisit else digest}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip header without name and time
    return packer.compress(("\r\n".join(head) + "\r\n\r\n").encode("ascii") + block + b"\r\n\r\n") + packer.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a file; raises ValueError where a length or a digest is wrong."""
    at, view = 0, memoryview(data)
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:  # in steps, so that what lies behind a record is copied in small pieces only
            if at >= len(view):
                raise ValueError("a record is cut off")
            parts.append(unpacker.decompress(view[at : at + 4096]))
            at = min(len(view), at + 4096)
        at -= len(unpacker.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("ascii").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(headers["content-length"])
        block = rest[:size]
        if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or headers["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise ValueError(f"a broken record: {headers.get('warc-record-id')}")
        yield headers, block


def _page_id(uri: str | None) -> int | None:
    number = uri[len("<urn:x-page:") : -1] if uri else "null"
    return None if number == "null" else int(number)


class _Roller:
    """Writes the files of one shard: temporary names, rolled by compressed size, renamed when complete."""

    def __init__(self, out: str, roll_bytes: int):
        self.fs, self.base = open_store(out)
        self.roll_bytes, self.shard, self.part = roll_bytes, None, 0
        self.sink = None

    def add(self, shard: int, record: bytes) -> Iterator[tuple]:
        if shard != self.shard or (self.sink is not None and self.size + len(record) > self.roll_bytes):
            yield from self.close()
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard = shard
        if self.sink is None:
            self.temp = f"{self.base}/_temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.sink, self.size, self.count, self.digest = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.sink.write(record)
        self.digest.update(record)
        self.size += len(record)
        self.count += 1

    def close(self) -> Iterator[tuple]:
        if self.sink is not None:
            self.sink.close()
            self.sink = None
            name = f"records-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.fs.move(self.temp, f"{self.base}/{name}")  # a second attempt puts the same bytes there
            yield self.shard, name, self.count, self.size, self.digest.hexdigest()


def write_archive(pages: DataFrame, out: str, shard_bytes: int = 24 << 20, roll_bytes: int = 4 << 20, level: int = 4, revisit_min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) below ``out``; returns the manifest, a committed table.

    Shuffles: the digests (no payloads) once, to find the smallest id of equal payloads; the payloads once, to sort.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    keys = rows.select("page_id", digest.alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= revisit_min_bytes)
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    again = keys.join(groups, "digest").select("page_id", "digest", F.col("first_id").alias("refers_to"), F.lit(True).alias("again")).distinct()
    bounds = range_bounds(rows.withColumn("n", F.octet_length("html")), "page_id", F.col("n") + 200, shard_bytes)
    # A row that tells of a group comes just before the records of the same id and payload: one shuffle serves both.
    told = again.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    records = rows.select("page_id", digest.alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("refers_to"), "url", "html")
    tagged = shard_column(told.unionByName(records), "page_id", bounds)
    dealt = deal(tagged, len(bounds) + 1).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", F.asc_nulls_first("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done = _Roller(out, roll_bytes), []
        group, used = None, False
        for batch in batches:
            for page_id, digest, kind, refers_to, url, page, shard in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "kind", "refers_to", "url", "html", "shard")), strict=True):
                key = (page_id, digest)
                if kind == 0:
                    group, used, target = key, False, refers_to
                    continue
                revisit = key == group and (used or target != page_id)
                if key == group:
                    used = True
                payload = page.encode("utf-8", "surrogatepass")
                record = write_record(page_id, url, payload, target if revisit else None, revisit, base64.b32encode(bytes.fromhex(digest)).decode(), level)
                done += roller.add(shard, record)
        done += roller.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "file", "n_records", "n_bytes", "sha256"])

    manifest = dealt.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{out}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def read_archive(spark: SparkSession, out: str, tasks: int | None = None) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of each record.

    The files of the manifest are dealt out to tasks; each is checked against its digest and parsed record by record.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    n = tasks or max(spark.sparkContext.defaultParallelism, min(4096, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(out)
        for batch in batches:
            for name, sha in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                rows: list[tuple] = []
                size = 0
                for head, block in read_records(data):
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and "sha1:" + base32_sha1(block) != head["warc-payload-digest"]:
                        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                    rows.append((_page_id(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], _page_id(head.get("warc-refers-to")), int(head["x-payload-length"]), head["warc-payload-digest"][5:], None if revisit else block))
                    size += len(block)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return manifest.select("file", "sha256").repartition(n).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Writes the archive of pages to the shared folder, reads it back and returns what its records say."""
    spark = pages.sparkSession
    out = shared_path(spark, "warc")
    write_archive(pages, out)
    return read_archive(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
