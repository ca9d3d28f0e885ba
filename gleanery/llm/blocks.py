"""Removal of repeated word windows through fixed-block anchors."""

from __future__ import annotations

import hashlib
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from gleanery.llm import exchange
from gleanery.llm.exchange import Chunk, Payloads, RangeHash, by_bucket, covered, mixed, pack, short_keys, units, unpack

WINDOW = 13
SPACE = re.compile(rb"[\x20\x09-\x0d]")
INDEXED = np.uint32(1 << 31)
BLOCK_BASE, WINDOW_BASE, BUCKET_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xC2B2AE3D27D4EB4F
SPELLED = 8                                     # bytes of a word that fit its hash
LENGTHS = np.uint64(0x9E3779B97F4A7C15)


def _next_space(text: bytes, at: int) -> int:
    found = SPACE.search(text, at)
    return found.start() if found else len(text)


def _word_hashes(data: bytes, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of up to eight bytes as the number they spell, longer ones by XXH3.

    A polynomial would not do: powers of two letters in Thue-Morse order cancel in it.
    """
    size = end - start
    found = np.zeros(len(start), np.uint64)
    for k in range(SPELLED):
        inside = np.flatnonzero(size > k)
        found[inside] |= letters[start[inside] + k].astype(np.uint64) << np.uint64(8 * k)
    found = mixed(found + size.astype(np.uint64) * LENGTHS)
    long = np.flatnonzero(size > SPELLED)
    found[long] = np.fromiter(
        (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long)
    )
    return found


class Words:
    """Hashes of the words of a chunk, document after document."""

    def __init__(self, chunk: Chunk):
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for group in units(chunk.texts, _next_space):
            data = b"\n".join([*(chunk.texts[row][a:b] for row, a, b in group), b""])
            letters = np.frombuffer(data, np.uint8)
            space = (letters == 32) | ((letters >= 9) & (letters <= 13))
            edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
            start, end = edges[0::2][:len(edges) // 2], edges[1::2]
            hashes.append(_word_hashes(data, letters, start, end))
            limits = np.cumsum([b - a + 1 for _, a, b in group])
            rows.append(np.array([row for row, _, _ in group])[np.searchsorted(limits, start, side="right")])
        self.hashes, self.rows = np.concatenate(hashes), np.concatenate(rows)
        self.counts = np.bincount(self.rows, minlength=len(chunk.docs)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.docs = chunk.docs

    def starts(self, size: int) -> np.ndarray:
        """Places where ``size`` words of one document start."""
        at = np.arange(len(self.hashes))
        return at[at + size <= (self.first + self.counts)[self.rows]]


class Blocks:
    """Distinct rolling block hashes of a chunk as short keys, and which are indexed."""

    def __init__(self, words: Words, window: int, buckets: int):
        size = (window + 1) // 2
        at = words.starts(size)
        keys = short_keys(RangeHash(words.hashes, BLOCK_BASE).of(at, at + size), buckets)
        self.short, place = np.unique(keys, return_inverse=True)
        self.indexed = np.zeros(len(self.short), bool)
        self.indexed[place[(at - words.first[words.rows[at]]) % size == 0]] = True
        docs = words.docs[words.rows[at]]
        low, high = np.full(len(self.short), exchange.NO_DOC), np.full(len(self.short), np.iinfo(np.int64).min)
        np.minimum.at(low, place, docs)
        np.maximum.at(high, place, docs)
        self.local = self.indexed & (low != high)
        self.at, self.place = at, place


class Windows:
    """Distinct windows of a chunk by bucket and hash, with the smallest document of each."""

    def __init__(self, words: Words, window: int, buckets: int):
        self.at = words.starts(window)
        end = self.at + window
        hashes = RangeHash(words.hashes, WINDOW_BASE).of(self.at, end)
        bucket = RangeHash(words.hashes, BUCKET_BASE).of(self.at, end) % np.uint64(buckets)
        order = np.lexsort((hashes, bucket))
        new = np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(bucket[order]) != 0))[:len(order)]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        firsts = order[new]
        self.hashes, self.bucket = hashes[firsts], bucket[firsts]
        self.docs = words.docs[words.rows[self.at]]
        self.low = np.full(len(firsts), exchange.NO_DOC)
        np.minimum.at(self.low, self.rank, self.docs)


def rounds(window: int) -> exchange.Rounds:
    size = (window + 1) // 2

    def ask(chunk: Chunk, buckets: int) -> Payloads:
        """Every rolling block of the chunk, marked where it is a reference block."""
        blocks = Blocks(Words(chunk), window, buckets)
        entries = blocks.short.astype(np.uint32) | np.where(blocks.indexed, INDEXED, np.uint32(0))
        return ((bucket, pack(entries[part])) for bucket, part in by_bucket(blocks.short))

    def answer(asked: list[tuple[int, bytes]]) -> Payloads:
        """Which of a chunk's blocks another chunk has indexed."""
        arrays = [unpack(payload)[0] for _, payload in asked]
        indexed, times = np.unique(
            np.concatenate([a[a >= INDEXED] & ~INDEXED for a in arrays]), return_counts=True
        )
        for (chunk, _), entries in zip(asked, arrays, strict=True):
            keys = entries & ~INDEXED
            at = np.minimum(np.searchsorted(indexed, keys), max(0, len(indexed) - 1))
            live = np.zeros(len(keys), bool)
            if len(indexed):
                live = (indexed[at] == keys) & (times[at] > (entries >= INDEXED))
            if live.any():
                yield chunk, pack(np.packbits(live))

    def ask_again(chunk: Chunk, buckets: int, told: list[tuple[int, bytes]]) -> Payloads:
        """Every distinct window around a block that was hit, with its smallest document here."""
        words = Words(chunk)
        blocks = Blocks(words, window, buckets)
        live, answers = blocks.local.copy(), dict(told)
        for bucket, part in by_bucket(blocks.short):
            if bucket in answers:
                live[part] |= np.unpackbits(unpack(answers[bucket])[0], count=part.stop - part.start).astype(bool)
        hit = np.zeros(len(words.hashes) + 1, np.int64)
        hit[blocks.at[live[blocks.place]] + 1] = 1
        hits = np.cumsum(hit)
        windows = Windows(words, window, buckets)
        near = np.zeros(len(windows.hashes), bool)
        near[windows.rank[hits[windows.at + window - size + 1] > hits[windows.at]]] = True
        rank = np.flatnonzero(near)
        table, number = np.unique(windows.low[rank], return_inverse=True)
        ordered = windows.bucket[rank] << np.uint64(32)
        for bucket, part in by_bucket(ordered):
            mine, at = np.unique(number[part], return_inverse=True)
            yield bucket, pack(
                np.diff(rank[part], prepend=0).astype(np.uint32), windows.hashes[rank[part]],
                table[mine], at.astype(np.uint32),
            )

    def answer_again(asked: list[tuple[int, bytes]]) -> Payloads:
        """The smallest document of a window anywhere, where it is smaller than the chunk's."""
        arrays = [unpack(payload) for _, payload in asked]
        hashes = np.concatenate([a[1] for a in arrays])
        docs = np.concatenate([a[2][a[3]] for a in arrays])
        distinct, place = np.unique(hashes, return_inverse=True)
        low = np.full(len(distinct), exchange.NO_DOC)
        np.minimum.at(low, place, docs)
        smallest, at = low[place], 0
        for (chunk, _), (steps, mine, _, _) in zip(asked, arrays, strict=True):
            part = slice(at, at + len(mine))
            at += len(mine)
            smaller = smallest[part] < docs[part]
            if smaller.any():
                rank = np.cumsum(steps.astype(np.int64))[smaller]
                table, number = np.unique(smallest[part][smaller], return_inverse=True)
                yield chunk, pack(np.diff(rank, prepend=0).astype(np.uint32), table, number.astype(np.uint32))

    def finish(chunk: Chunk, buckets: int, told: list[tuple[int, bytes]]):
        words = Words(chunk)
        windows = Windows(words, window, buckets)
        for _, payload in told:
            steps, table, number = unpack(payload)
            windows.low[np.cumsum(steps.astype(np.int64))] = table[number]
        gone = windows.at[windows.low[windows.rank] < windows.docs]
        cover = covered(gone, gone + window, len(words.hashes))
        kept, removed = [], []
        for text, first, count in zip(chunk.texts, words.first, words.counts, strict=True):
            mask = cover[first:first + count]
            removed.append(int(mask.sum()))
            kept.append(b" ".join(compress(text.split(), ~mask) if removed[-1] else text.split()))
        return (
            pa.array(kept, pa.binary()),
            pa.array(words.counts, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        )

    return exchange.Rounds(ask, answer, ask_again, answer_again, finish)


def without_repeats(
    docs: DataFrame, window: int = WINDOW,
    chunk_bytes: int = exchange.CHUNK_BYTES, bucket_bytes: int = exchange.BUCKET_BYTES,
) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the words repeated from smaller doc_ids taken out.

    Reference blocks of ``(window + 1) // 2`` words stand end to end in every document;
    any window of another document that equals one of its windows contains a whole
    block, so every rolling block is probed. Windows around hits are then compared
    exactly (by 64-bit hashes within buckets chosen by another hash), and their union
    makes the maximal repeats.

    Every column but ``text`` is kept; ``_found`` holds kept (words joined by a space),
    n_words, n_removed and kept_sha256. Null or blank texts have no words. A missing
    doc_id counts as larger than all others, so such rows are never a reference for
    others; rows with equal doc_id do not shorten each other.
    """
    return exchange.run(
        docs, rounds(window),
        "kept binary, n_words bigint, n_removed bigint, kept_sha256 string",
        chunk_bytes, bucket_bytes,
    )


def report(docs: DataFrame, **sizes: int) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"), **sizes)
    return found.select("doc_id", "_found.n_words", "_found.n_removed", "_found.kept_sha256")


SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from d),
s as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as gram from g),
m as (select *, min(doc_id) over (partition by gram) as low from s),
c as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as i from m where low < doc_id),
k as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)) as keep, len(gone) as n
      from (select d.doc_id, d.w, coalesce(r.gone, []::bigint[]) as gone
            from d left join (select doc_id, list(i) as gone from c group by doc_id) r using (doc_id)))
select doc_id, cast(len(w) as bigint) as n_words, cast(n as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_transform(keep, lambda i: w[i]), ' '), '')) as kept_sha256
from k
"""
