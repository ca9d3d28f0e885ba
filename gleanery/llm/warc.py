"""WARC archives whose records share an embedded Zstandard dictionary."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import staged

# fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D          # skippable frame that carries the dictionary
TRAINED_DICTIONARY = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20               # uncompressed records per archive
DICTIONARY_BYTES = 64 << 10
TRAINING_BYTES = 2 << 20               # evenly spaced records the dictionary is built from
LEVEL = 3
GUESS = 8 << 10                        # bytes tried first when reading a frame


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the digest and length, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~')}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from evenly spaced records of the archive, ``TRAINING_BYTES`` at most.

    Archives too small to train on use plain record bytes as the dictionary.
    """
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    samples, left = [], TRAINING_BYTES
    for sample in records[::step]:
        samples.append(sample[:left])
        left -= len(samples[-1])
        if left <= 0:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(
            b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )


def archive(records: list[bytes]) -> bytes:
    """The dictionary in a leading skippable frame, then one frame per record."""
    dictionary = build_dictionary(records)
    content = dictionary.as_bytes()
    dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    return b"".join(
        [struct.pack("<II", DICTIONARY_FRAME, len(content)), content, *map(compressor.compress, records)]
    )


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("archive has no leading dictionary frame")
    content = data[8:8 + size]
    kind = (
        zstandard.DICT_TYPE_FULLDICT if content.startswith(TRAINED_DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    )
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    at = 8 + size
    while at < len(data):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = data[at:at + GUESS]
            if not piece:
                raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload inside the HTTP block."""
    header, _, rest = data.partition(b"\r\n\r\n")
    lines = header.decode().split("\r\n")
    fields = dict((name.lower(), value) for name, value in (line.split(": ", 1) for line in lines[1:]))
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = http.decode().rpartition("Content-Length: ")[2]
    return fields, payload


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` plus ``refers_to``: the page whose response a revisit points to.

    Only digests and ids are grouped. The join that brings the answer back is on
    page_id, so many copies of one payload do not meet in a task.
    """
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "same", F.when(F.octet_length("html") >= MIN_REVISIT_BYTES, F.sha2("html", 256))
    )
    large = named.where("same is not null and page_id is not null").select("page_id", "same")
    heads = (
        large.groupBy("same").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    revisits = large.join(heads, "same").where("page_id <> head").distinct()
    return named.join(revisits, ["page_id", "same"], "left").select(
        "page_id", "url", "html", F.col("head").alias("refers_to")
    )


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(name, records, content): WARC archives of ``pages`` (page_id, url, html).

    Every task closes an archive once it holds ``archive_bytes``, so memory is
    bounded. Of pages with equal html of at least 1000 bytes that with the largest
    page_id is the response and the others revisit it; rows repeating that page_id
    are responses too. Null html is empty, a null url is left out, and a page
    without id is always a response. No pages: no archives. Other columns are not read.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[bytes]) -> pa.RecordBatch:
            content = archive(held)
            name = f"{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())],
                names=["name", "records", "content"],
            )

        held, size = [], 0
        for batch in batches:
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)]
            for row in zip(*columns, strict=True):
                page_id, url, payload, refers_to = (value.as_py() for value in row)
                held.append(record(page_id, url, payload, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return with_revisits(pages).mapInArrow(write, "name string, records long, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of ``archives`` (content), checked against its digest."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in read_archive(content.as_py()):
                    fields, payload = parse_record(data)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    ids = [fields.get(f, "").rpartition(":")[2].rstrip(">") for f in ("warc-record-id", "warc-refers-to")]
                    rows.append(
                        (
                            *(None if i in ("", "none") else int(i) for i in ids),
                            len(payload) if kind == "response" else int(fields["http-length"]),
                            digest,
                            kind,
                            fields.get("warc-target-uri"),
                            payload if kind == "response" else None,
                        )
                    )
                    if len(rows) == 2000:
                        yield to_batch(rows)
                        rows = []
                if rows:
                    yield to_batch(rows)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "refers_to", "payload_bytes", "payload_digest", "record_type", "target_uri", "payload"]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    return archives.select("content").mapInArrow(
        read,
        "page_id long, refers_to long, payload_bytes long, payload_digest string, "
        "record_type string, target_uri string, payload binary",
    )


def save(archives: DataFrame, uri: str) -> DataFrame:
    """Write every archive as a file below ``uri`` (any store pyarrow knows); (name, bytes).

    Names derive from the content, so a repeated task writes the same file again.
    """

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([len(data)], pa.int64())], names=["name", "bytes"]
                )

    return archives.select("name", "content").mapInArrow(put, "name string, bytes long")


def load(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(uri).select("content")


def report(pages: DataFrame) -> DataFrame:
    archives = staged(write_archives(pages))
    return read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# "octet_length" counts bytes; equal texts have equal UTF-8
SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select *, octet_length(encode(html)) as n,
        case when octet_length(encode(html)) >= 1000
             then max(page_id) over (partition by html) end as head from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest,
       case when head > page_id then 'revisit' else 'response' end as record_type,
       case when head > page_id then head end as refers_to
from s
"""
