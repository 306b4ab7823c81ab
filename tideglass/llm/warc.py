"""WARC archives of web pages, compressed record by record with a Zstandard dictionary.

An archive file (.warc.zst) begins with a skippable frame that holds the dictionary; behind it every record is a frame of
its own, so that one record is read without the others.  The dictionary is trained in one task on a bounded sample of
archived records (SAMPLE records, of each the first SAMPLE_BYTES) and is the same in all files of an archive; a table too
small to train on gives files without that frame.  The tasks that read the pages write the files: each rolls over at
FILE_BYTES, and a table of the written files is the archive's manifest.

Of pages with equal payloads of LEAST bytes or more (compared by SHA-256), the one with the largest page_id is a
`response`; the others are `revisit` records without payload that name its record.  Reading takes everything from
the files: lengths and digests of responses are computed anew from their payloads and checked, those of revisits stand in their
record (Content-Length of the HTTP head, WARC-Payload-Digest).

Cases: null html is an empty payload; a null page_id counts as the smallest; rows that repeat the largest page_id are all
responses; null urls are replaced by the page's URN, others are percent-encoded where a header could not hold them; very long pages are
records like others, one at a time in memory; an empty table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.files import published, store
from tideglass.llm.shared import Scratch, batched, delete, keep, lean, new_path, small, small_batches

#: Least payload that is stored once only.
LEAST = 1000
#: The dictionary: its bytes, the records it is trained on and the bytes taken of each.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 1 << 16, 2000, 1 << 14
#: Bytes after which a task begins another file.
FILE_BYTES = 1 << 30
#: Rows of the table of repeated payloads (about 150 bytes each) that may be broadcast.
REPEATED = 200_000
LEVEL = 3
# Fixed values of the formats.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = b""
_URL = ":/?#[]@!$&'()*+,;=%-._~"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _page_of(urn: str) -> int | None:
    found = urn.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def _target(url: str | None, page_id: int | None) -> str:
    return quote(url, safe=_URL) if url else f"urn:page:{'null' if page_id is None else page_id}"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, original: tuple[int | None, str | None] | None = None) -> bytes:
    """A response record, or a revisit of the original (page_id, url) with the same payload; digest is the payload's SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Target-URI", _target(url, page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response")]
    if original:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(original[0], digest)), ("WARC-Refers-To-Target-URI", _target(original[1], original[0])), ("WARC-Refers-To-Date", date)]
    return _record(fields, http if original else http + payload)


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if first != "WARC/1.1" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('warc-record-id')}")
    return fields, rest[:size]


def _described(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest, kind = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its head")
    return _page_of(fields["warc-record-id"]), size, digest, kind, _page_of(fields["warc-refers-to"]) if kind == "revisit" else None


def _sha1(html: bytes) -> str:
    return hashlib.sha1(html).hexdigest()


def train(pages: DataFrame, date: str, size: int = DICTIONARY) -> bytes:
    """A dictionary of at most `size` bytes from a sample of the pages' records; none if the sample is too small."""
    n = pages.count()
    some = pages.select("page_id", "url", F.substring(F.coalesce(F.encode("html", "UTF-8"), F.lit(_EMPTY)), 1, SAMPLE_BYTES).alias("html"))
    some = some.sample(min(1.0, 1.2 * SAMPLE / n), seed=11) if n > SAMPLE else some

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        for batch in it:
            for row in batch.to_pylist()[: SAMPLE - len(records)]:
                records.append(record(row["page_id"], row["url"], row["html"], _sha1(row["html"]), date))
        try:
            data = zstd.train_dictionary(size, records).as_bytes()
        except zstd.ZstdError:
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    return some.repartition(1).mapInArrow(run, "data binary").first().data if n else b""


def with_originals(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html as bytes) with original: (page_id, url) of the response that a row revisits, else null."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(_EMPTY)).alias("html"))
    rows = rows.withColumn("_key", F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256))))
    # partial sums before the shuffle: a payload that a third of the pages share is one row a task
    groups = rows.where("_key is not null").groupBy("_key").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("_best")).where("n > 1")
    groups = scratch.keep(groups.select("_key", "_best"), "repeated")
    rows = rows.join(small(groups, REPEATED), "_key", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("_best.page_id"))
    return rows.select("page_id", "url", "html", F.when(F.col("_best").isNotNull() & other, F.col("_best")).alias("original"))


_FILES = "path string, records long, bytes long"


def write(pages: DataFrame, folder: str, dictionary: bytes, date: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of with_originals to archive files in folder; (path, records, bytes) of each file, as a kept table."""
    staging = f"{folder}-staging"

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done = TaskContext.get().partitionId(), 0, []
        made = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        rows = (row for batch in small_batches(it, 100) for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            path, records, size = f"{folder}/part-{part:06d}-{seq:04d}.warc.zst", 0, 0
            with published(path, staging) as out:
                if dictionary:
                    out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{part}:{seq}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                out.write(made.compress(info))
                while row is not None and size < file_bytes:
                    at = row["original"]
                    frame = made.compress(record(row["page_id"], row["url"], row["html"], _sha1(row["html"]), date, at and (at["page_id"], at["url"])))
                    out.write(frame)
                    records, size, row = records + 1, size + len(frame), next(rows, None)
            done.append((path, records, size))
            seq += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    files = keep(pages.mapInArrow(run, _FILES), "archive-files", 200)
    delete(pages.sparkSession, staging)
    return files


def frames(stream) -> Iterator[bytes]:
    """The records of an archive file, one after the other."""
    first = stream.read(8)
    size = struct.unpack("<II", first) if len(first) == 8 else (0, 0)
    dictionary = stream.read(size[1]) if size[0] == MAGIC else b""
    opened = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = b"" if dictionary else first
    while rest := rest or stream.read(1 << 20):
        frame, parts = opened.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("the file ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit in the files of a manifest."""

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for path in (p for batch in it for p in batch.column(0).to_pylist()):
            system, place = store(path)
            rows: list[tuple] = []
            with system.open_input_stream(place, compression=None) as stream:
                for fields, block in map(_parse, frames(stream)):
                    if fields["warc-type"] != "warcinfo":
                        rows.append(_described(fields, block))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = files.select("path").repartition(max(1, files.count()))
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) to a dictionary-compressed archive in folder; its manifest."""
    spark = pages.sparkSession
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    with batched(spark, 100):
        dictionary = train(pages, date)
    with Scratch(spark) as scratch:
        return write(with_originals(pages, scratch), folder, dictionary, date)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in a new folder of the shared one, which stays, and read the records back."""
    spark: SparkSession = pages.sparkSession
    return keep(read(archive(pages, new_path(spark, "warc"))), "warc-records")
