"""Two rounds of questions between text chunks and hash buckets.

Repeats across a corpus are found without moving windows of text as rows. The
documents are dealt once into chunks of a few megabytes. Each chunk sends packed
arrays to hash buckets, gets packed answers, sends narrower questions, gets
answers again, and writes its documents. A chunk merges what it asks for more than
once, so a passage in a third of all documents is one entry per chunk. The
shuffle of the texts is the same in all three uses and is reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from gleanery.llm.common import bounded_batches, release

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
PIECE_BYTES = 1 << 18          # bytes of text turned into arrays at once
NO_DOC = np.iinfo(np.int64).max  # a missing doc_id: larger than any other

Payloads = Iterable[tuple[int, bytes]]


@dataclass
class Chunk:
    """The documents of a chunk in a fixed order, whatever order they came in."""

    docs: np.ndarray
    texts: list[bytes]
    rows: np.ndarray

    @classmethod
    def of(cls, part: pa.Table) -> Chunk:
        ids = part.column("doc_id").combine_chunks()
        docs = ids.fill_null(NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [t or b"" for t in part.column("text").to_pylist()]
        rows = np.array(sorted(range(len(texts)), key=lambda i: (docs[i], texts[i])), np.int64)
        return cls(docs[rows], [texts[i] for i in rows], rows)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, compressed."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(payload: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    at = 4 + int.from_bytes(data[:4], "little")
    arrays = []
    for item in data[4:at].decode().split(";"):
        kind, size = item.split(",")
        arrays.append(np.frombuffer(data, kind, int(size), at))
        at += arrays[-1].nbytes
    return arrays


@dataclass
class Rounds:
    """The functions of both rounds; every one sees a chunk or a bucket at a time.

    ask: chunk to (bucket, payload) pairs. answer: [(chunk, payload)] of a bucket to
    (chunk, payload) pairs. ask_again: chunk and its answers to pairs. answer_again:
    like answer. finish: chunk and its last answers to one array per output column.
    """

    ask: Callable[[Chunk, int], Payloads]
    answer: Callable[[list[tuple[int, bytes]]], Payloads]
    ask_again: Callable[[Chunk, int, list[tuple[int, bytes]]], Payloads]
    answer_again: Callable[[list[tuple[int, bytes]]], Payloads]
    finish: Callable[[Chunk, int, list[tuple[int, bytes]]], Sequence[pa.Array]]


SENT = "chunk int, bucket int, payload binary"


def _pairs(part: pa.Table, key: str) -> list[tuple[int, bytes]]:
    return list(zip(part.column(key).to_pylist(), part.column("payload").to_pylist(), strict=True))


def _sent(chunk: list[int], bucket: list[int], payload: list[bytes]) -> pa.Table:
    return pa.table(
        [pa.array(chunk, pa.int32()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())],
        names=["chunk", "bucket", "payload"],
    )


def run(
    docs: DataFrame, rounds: Rounds, schema: str,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) and, as struct ``_found``, what ``finish`` makes.

    ``schema`` is the struct's fields as DDL.
    """
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"),
    )
    by_chunk = dealt.groupBy("chunk")
    made = T.StructType.fromDDL(schema)
    fields = made.fieldNames()

    def spread(part: pa.Table, found: Payloads) -> pa.Table:
        pairs = list(found)
        release()
        chunk = part.column("chunk")[0].as_py() if len(part) else 0
        return _sent([chunk] * len(pairs), [b for b, _ in pairs], [p for _, p in pairs])

    def back(part: pa.Table, found: Payloads) -> pa.Table:
        pairs = list(found)
        release()
        bucket = part.column("bucket")[0].as_py() if len(part) else 0
        return _sent([c for c, _ in pairs], [bucket] * len(pairs), [p for _, p in pairs])

    def ask(part: pa.Table) -> pa.Table:
        return spread(part, rounds.ask(Chunk.of(part), buckets))

    def answer(part: pa.Table) -> pa.Table:
        return back(part, rounds.answer(_pairs(part, "chunk")))

    def ask_again(part: pa.Table, told: pa.Table) -> pa.Table:
        return spread(part, rounds.ask_again(Chunk.of(part), buckets, _pairs(told, "bucket")))

    def answer_again(part: pa.Table) -> pa.Table:
        return back(part, rounds.answer_again(_pairs(part, "chunk")))

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk.of(part)
        found = rounds.finish(chunk, buckets, _pairs(told, "bucket"))
        rest = part.column("rest").combine_chunks().take(pa.array(chunk.rows))
        columns = pa.StructArray.from_arrays(list(found), names=fields)
        release()
        return pa.table([rest, columns], names=["rest", "found"])

    def over(answers: DataFrame, step, out: str | T.StructType) -> DataFrame:
        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(step, out)

    first = by_chunk.applyInArrow(ask, SENT).groupBy("bucket").applyInArrow(answer, SENT)
    second = over(first, ask_again, SENT).groupBy("bucket").applyInArrow(answer_again, SENT)
    out = T.StructType([T.StructField("rest", dealt.schema["rest"].dataType), T.StructField("found", made)])
    done = over(second, finish, out)
    kept = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c != "text"]
    return done.select(*kept, F.col("found").alias("_found"))


def units(texts: list[bytes], cut: Callable[[bytes, int], int]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, from, to) of about PIECE_BYTES; ``cut`` moves an inner border to a valid place."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= PIECE_BYTES else cut(text, at + PIECE_BYTES)
            held.append((row, at, end))
            size += end - at
            at = end
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit numbers, independent of where they stand."""

    _cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        size = len(values) + 1
        if base not in self._cache or len(self._cache[base][0]) < size:
            room = max(size, PIECE_BYTES + (1 << 16))
            self._cache[base] = powers(base, room), powers(pow(base, -1, 1 << 64), room)
        up, self.down = self._cache[base]
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(values * up[:size - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 31 further bits of the key."""
    bucket = (keys >> np.uint64(33)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (keys & np.uint64(0x7FFFFFFF))


def by_bucket(sorted_short: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal buckets in sorted short keys."""
    bucket = (sorted_short >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    for start, end in zip(starts, np.append(starts, len(bucket))[1:], strict=True):
        yield int(bucket[start]), slice(int(start), int(end))


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any of the half-open ranges."""
    edge = np.bincount(starts, minlength=size + 1)[:size + 1] - np.bincount(ends, minlength=size + 1)[:size + 1]
    return np.cumsum(edge[:size]) > 0
