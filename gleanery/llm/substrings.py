"""Removal of repeated byte strings through suffix arrays of text shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm import exchange
from gleanery.llm.common import packed, release, unpacked
from gleanery.llm.exchange import Chunk, Payloads, RangeHash, by_bucket, covered, mixed, pack, short_keys, units, unpack
from gleanery.llm.suffixes import permuted_prefixes, suffix_array

LENGTH = 50
GRAM = 32                    # bytes of the anchors that decide a window's shard
SEVERAL = np.uint32(1 << 31)
HOT_BYTES = 1 << 20          # distinct segments of an anchor beyond which they are cut into windows
PART_BYTES = 1 << 19         # distinct segments of a hot anchor for each bucket its windows are dealt to
PLAIN_BYTES = 256            # what an anchor may have in a chunk without being listed with its size
SHARD_BYTES = 4 << 20        # letters of one suffix array; one anchor more at most
FIRST_BASE = 0x9E3779B97F4A7C15
FACTORS = ((8, 0xC2B2AE3D27D4EB4F), (16, 0xD1342543DE82EF95))      # what joins the sums of so many bytes


def _grams(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at every place of ``data`` (which is padded by GRAM bytes)."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()      # the 8 bytes from every place
    # one linear combination, then one scrambling round
    spare = np.empty_like(words)
    for width, factor in FACTORS:
        later = np.multiply(words[width:], np.uint64(factor), out=spare[:len(words) - width])
        words = np.add(words[:-width], later, out=words[:-width])
    spare = spare[:len(words)]
    words ^= np.right_shift(words, np.uint64(32), out=spare)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    words ^= np.right_shift(words, np.uint64(29), out=spare)
    return words


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:]) if width > span else values


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``sizes`` that begin at ``begins``, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class Segments:
    """The stretches of a chunk's texts whose windows share their smallest anchor.

    A window's smallest anchor depends on its content alone, so equal windows
    anywhere lie in segments of the same anchor. Segments with equal content are
    one group; groups are numbered by content, so their numbers can be found again.
    """

    def __init__(self, chunk: Chunk, length: int):
        lens = np.array([len(t) for t in chunk.texts], np.int64)
        self.first = np.cumsum(lens) - lens
        self.total = int(lens.sum())
        parts = [np.zeros((6, 0), np.uint64)]
        for group in units(chunk.texts, lambda text, at: at):
            pieces = [chunk.texts[row][a:b + length - 1] for row, a, b in group]
            sizes = np.array([len(p) for p in pieces], np.int64)
            data = b"".join([*pieces, bytes(GRAM)])
            grams = _grams(data)
            ends = np.cumsum(sizes)
            lowest = _window_minimum(grams, length - GRAM + 1)
            valid = np.zeros(len(lowest) + 2, bool)      # a place more on either side
            for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                valid[end - size + 1:max(end - size, end - length + 1) + 1] = True
            joined = np.zeros(len(lowest) + 1, bool)
            np.equal(lowest[1:], lowest[:-1], out=joined[1:-1])
            joined &= valid[:-1]
            joined &= valid[1:]
            begin = np.flatnonzero(valid[1:-1] & ~joined[:-1])
            if not len(begin):
                continue
            end = np.flatnonzero(valid[1:-1] & ~joined[1:]) + length
            hashes = RangeHash(grams, FIRST_BASE)
            sums = np.zeros(len(grams) + 1, np.uint64)
            np.cumsum(grams, out=sums[1:])
            stop = end - GRAM + 1
            unit = np.searchsorted(ends, begin, side="right")
            row = np.array([r for r, _, _ in group], np.int64)[unit]
            offset = np.array([a for _, a, _ in group], np.int64) - (ends - sizes)
            parts.append(
                np.stack(
                    [
                        lowest[begin], hashes.of(begin, stop), sums[stop] - sums[begin],
                        row.astype(np.uint64), (begin + offset[unit]).astype(np.uint64),
                        (end - begin).astype(np.uint64),
                    ]
                )
            )
        key, first, second, row, begin, size = np.concatenate(parts, axis=1)
        order = np.argsort(first)
        key, first, second = key[order], first[order], second[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[:len(order)]
        self.group = np.cumsum(new) - 1
        self.row = row[order].astype(np.int64)
        self.begin, self.size = begin[order].astype(np.int64), size[order].astype(np.int64)
        self.docs = chunk.docs[self.row]
        self.heads = np.flatnonzero(new)
        self.key = key[self.heads]
        self.low = np.minimum.reduceat(self.docs, self.heads) if len(order) else self.docs
        self.high = np.maximum.reduceat(self.docs, self.heads) if len(order) else self.docs


class Windows:
    """Single windows of a chunk's segment ``groups``; equal ones, by 128 bits, have one number."""

    def __init__(self, chunk: Chunk, segments: Segments, groups: np.ndarray, length: int):
        parts = [np.zeros((4, 0), np.uint64)]
        heads = segments.heads[groups]
        sizes = segments.size[heads]
        batch = np.cumsum(sizes) // exchange.PIECE_BYTES
        for number in np.unique(batch):
            mine = np.flatnonzero(batch == number)
            data = b"".join(
                chunk.texts[row][begin:begin + size]
                for row, begin, size in zip(
                    segments.row[heads[mine]].tolist(), segments.begin[heads[mine]].tolist(), sizes[mine].tolist(),
                    strict=True,
                )
            )
            grams = _grams(data + bytes(GRAM))
            times = sizes[mine] - length + 1
            ends = np.cumsum(sizes[mine])
            offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = offset + np.repeat(ends - sizes[mine], times)
            stop = at + length - GRAM + 1
            sums = np.zeros(len(grams) + 1, np.uint64)
            np.cumsum(grams, out=sums[1:])
            parts.append(
                np.stack(
                    [
                        RangeHash(grams, FIRST_BASE).of(at, stop), sums[stop] - sums[at],
                        np.repeat(groups[mine], times).astype(np.uint64), offset.astype(np.uint64),
                    ]
                )
            )
        first, second, group, offset = np.concatenate(parts, axis=1)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[:len(order)]
        self.number = np.cumsum(new) - 1
        self.group, self.offset = group[order].astype(np.int64), offset[order].astype(np.int64)
        self.place = (self.group << 32) | self.offset
        self.heads = np.flatnonzero(new)
        self.key = first[self.heads]
        self.low, self.high = segments.low[self.group], segments.high[self.group]
        if len(order):
            self.low = np.minimum.reduceat(self.low, self.heads)
            self.high = np.maximum.reduceat(self.high, self.heads)


class Anchors:
    """Distinct anchors of a chunk as short keys, which of them several documents have, and
    the bytes of their distinct segments."""

    def __init__(self, segments: Segments, buckets: int):
        keys = short_keys(segments.key, buckets)
        order = np.argsort(keys)
        new = np.append(True, keys[order[1:]] != keys[order[:-1]])[:len(order)]
        heads = np.flatnonzero(new)
        self.short = keys[order[heads]]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        if len(order):
            low, high = segments.low[order], segments.high[order]
            self.several = np.minimum.reduceat(low, heads) != np.maximum.reduceat(high, heads)
            self.bytes = np.add.reduceat(segments.size[segments.heads[order]], heads)
        else:
            self.several, self.bytes = np.zeros(0, bool), np.zeros(0, np.int64)


def distinct(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each text, ``sizes`` of ``letters`` each, among the distinct ones, and those in the same form."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    texts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    found = texts.dictionary_encode()
    _, ends, content = found.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64, len(found.dictionary) + 1)
    return found.indices.to_numpy().astype(np.int64), np.frombuffer(content, np.uint8, ends[-1]), np.diff(ends)


def shard_minima(letters: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every window of every text: the smallest document of a text with an equal window.

    The texts, ``sizes`` of ``letters`` each, form one string with a separator after each;
    suffixes that share ``length`` letters stand together in its suffix array. A window with
    that many letters left in its text shares no separator, so groups hold windows only.
    """
    used = np.flatnonzero(np.bincount(letters, minlength=256))
    ranks = np.zeros(256, np.int16)
    ranks[used] = np.arange(len(used)) + 2
    string = np.insert(ranks[letters], np.cumsum(sizes), np.int16(1))
    string = np.append(string, np.int16(0))
    array = suffix_array(string, len(used) + 2)
    prefixes = permuted_prefixes(string, array)
    windows = np.stack([sizes - length + 1, np.full(len(sizes), length)], axis=1).ravel()
    valid = np.append(np.repeat(np.arange(len(windows)) % 2 == 0, windows), False)
    owned = np.append(np.repeat(docs, sizes + 1), exchange.NO_DOC)
    owned[~valid] = exchange.NO_DOC
    starts = np.flatnonzero(prefixes[array] < length)
    low = np.minimum.reduceat(owned[array], starts)
    owned[array] = np.repeat(low, np.diff(np.append(starts, len(array))))
    return owned[valid]


def window_minima(letters: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """As ``shard_minima``, sorting only texts whose anchor another text has.

    Equal windows have equal anchors, so a text alone with its anchor shares no window,
    and whole anchors can be sorted in shards of SHARD_BYTES.
    """
    begins, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    places = np.cumsum(windows) - windows
    minima = np.repeat(docs, windows)
    order = np.argsort(anchors, kind="stable")
    starts = np.flatnonzero(np.append(True, anchors[order[1:]] != anchors[order[:-1]]))
    times = np.diff(np.append(starts, len(order)))
    shared = order[np.repeat(times > 1, times)]
    ends = np.cumsum(times[times > 1])
    held = np.cumsum(sizes[shared] + 1)
    begin = before = 0
    for end in ends.tolist():
        if held[end - 1] - before < SHARD_BYTES and end < len(shared):
            continue
        part = shared[begin:end]
        found = shard_minima(letters[_ranges(begins[part], sizes[part])], sizes[part], docs[part], length)
        minima[_ranges(places[part], windows[part])] = found
        begin, before = end, held[end - 1]
    return minima


def rounds(length: int) -> exchange.Rounds:
    def ask(chunk: Chunk, buckets: int) -> Payloads:
        """Every anchor of the chunk, marked where several of its documents have it; sizes of large ones."""
        anchors = Anchors(Segments(chunk, length), buckets)
        entries = anchors.short.astype(np.uint32) | np.where(anchors.several, SEVERAL, np.uint32(0))
        for bucket, part in by_bucket(anchors.short):
            large = np.flatnonzero(anchors.bytes[part] > PLAIN_BYTES)
            yield bucket, pack(entries[part], large.astype(np.uint32), anchors.bytes[part][large])

    def answer(asked: list[tuple[int, bytes]]) -> Payloads:
        """Which of a chunk's anchors another document has, which of those are hot, and the buckets each of these gets.

        Unlisted sizes count as PLAIN_BYTES, so no anchor with more than HOT_BYTES is missed.
        """
        parts = [unpack(payload) for _, payload in asked]
        arrays = [entries for entries, _, _ in parts]
        keys = np.concatenate(arrays)
        sizes = np.full(len(keys), PLAIN_BYTES, np.int64)
        first = np.cumsum([0, *map(len, arrays)])
        for begin, (_, large, size) in zip(first.tolist(), parts, strict=False):
            sizes[begin + large.astype(np.int64)] = size
        known, place, times = np.unique(keys & ~SEVERAL, return_inverse=True, return_counts=True)
        live = times > 1
        live[place[keys >= SEVERAL]] = True
        mask = live[place]
        held = np.bincount(place, sizes).astype(np.int64)[place]
        hot = mask & (held > HOT_BYTES)
        at = 0
        for (chunk, _), entries in zip(asked, arrays, strict=True):
            part, cut = mask[at:at + len(entries)], np.flatnonzero(hot[at:at + len(entries)])
            if part.any():
                yield chunk, pack(np.packbits(part), cut.astype(np.uint32), 1 + held[at + cut] // PART_BYTES)
            at += len(entries)

    def ask_again(chunk: Chunk, buckets: int, told: list[tuple[int, bytes]]) -> Payloads:
        """The distinct segments of anchors that another document has; of hot ones their windows.

        A hot anchor's windows are dealt by their whole content, to as many buckets as its segments fill.
        """
        segments = Segments(chunk, length)
        anchors = Anchors(segments, buckets)
        live, parts, answers = np.zeros(len(anchors.short), bool), np.zeros(len(anchors.short), np.int64), dict(told)
        for bucket, part in by_bucket(anchors.short):
            if bucket in answers:
                bits, cut, dealt = unpack(answers[bucket])
                live[part] = np.unpackbits(bits, count=part.stop - part.start).astype(bool)
                parts[part.start + cut.astype(np.int64)] = dealt
        letters = np.frombuffer(b"".join(chunk.texts), np.uint8)
        if parts.any():
            groups = np.flatnonzero(parts[anchors.place])
            anchor = anchors.place[groups]
            yield from ask_windows(chunk, buckets, segments, letters, groups, anchors.short[anchor], parts[anchor])
        number = np.flatnonzero((live & (parts == 0))[anchors.place])
        short = anchors.short[anchors.place[number]]
        order = np.argsort(short, kind="stable")
        number, short = number[order], short[order]
        heads = segments.heads[number]
        begins, sizes = segments.first[segments.row[heads]] + segments.begin[heads], segments.size[heads]
        for bucket, part in by_bucket(short):
            mine = number[part]
            yield bucket, pack(
                mine.astype(np.uint32), short[part].astype(np.uint32),
                segments.low[mine], sizes[part].astype(np.uint32), letters[_ranges(begins[part], sizes[part])],
            )

    def ask_windows(
        chunk: Chunk, buckets: int, segments: Segments, letters: np.ndarray,
        groups: np.ndarray, short: np.ndarray, parts: np.ndarray,
    ) -> Payloads:
        """The distinct windows of segments, dealt to ``parts`` of the buckets behind the others by group.

        There are ``length`` such buckets for each of the others, as windows overlap.
        """
        windows = Windows(chunk, segments, groups, length)
        of = np.searchsorted(groups, windows.group[windows.heads])
        bucket = mixed(short[of]) % np.uint64(buckets * length) + windows.key % parts[of].astype(np.uint64)
        bucket = (bucket % np.uint64(buckets * length)).astype(np.int64) + buckets
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            at = windows.heads[part]
            head = segments.heads[windows.group[at]]
            begins = segments.first[segments.row[head]] + segments.begin[head] + windows.offset[at]
            yield int(bucket[part[0]]), pack(
                windows.place[at], windows.low[part], windows.high[part],
                letters[_ranges(begins, np.full(len(part), length))],
            )

    def answer_windows(asked: list[tuple[int, list[np.ndarray]]]) -> Payloads:
        """The smallest document of each window that is smaller than one of the chunk's."""
        letters = np.concatenate([content for _, (_, _, _, content) in asked])
        number, _, sizes = distinct(letters, np.full(len(letters) // length, length))
        smallest = np.full(len(sizes), exchange.NO_DOC)
        np.minimum.at(smallest, number, np.concatenate([low for _, (_, low, _, _) in asked]))
        at = 0
        for chunk, (place, _, high, _) in asked:
            low = smallest[number[at:at + len(place)]]
            at += len(place)
            smaller = low < high
            if smaller.any():
                yield chunk, pack(place[smaller], low[smaller])

    def told_windows(chunk: Chunk, segments: Segments, told: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, offset, smallest document) of all windows of the chunk that equal one told of."""
        place, value = map(np.concatenate, zip(*map(unpack, told), strict=True))
        keys = np.unique(segments.key[place >> 32])
        windows = Windows(chunk, segments, np.flatnonzero(np.isin(segments.key, keys)), length)
        order = np.argsort(windows.place)
        low = np.full(len(windows.heads), exchange.NO_DOC)
        low[windows.number[order[np.searchsorted(windows.place[order], place)]]] = value
        gone = np.flatnonzero(low[windows.number] < segments.high[windows.group])
        group = windows.group[gone]
        repeat = np.diff(np.append(segments.heads, len(segments.group)))[group]
        entry = np.repeat(gone, repeat)
        return _ranges(segments.heads[group], repeat), windows.offset[entry], low[windows.number[entry]]

    def answer_again(asked: list[tuple[int, bytes]]) -> Payloads:
        """Ranges of a segment's windows that a smaller document than the chunk's has."""
        first = unpack(asked[0][1])
        if len(first) == 4:                                  # a bucket of windows
            yield from answer_windows([(chunk, unpack(payload)) for chunk, payload in asked])
            return
        parts = [unpack(payload) for _, payload in asked]
        place, texts, sizes = distinct(np.concatenate([p[4] for p in parts]), np.concatenate([p[3] for p in parts]))
        anchors = np.empty(len(sizes), np.uint32)
        anchors[place] = np.concatenate([p[1] for p in parts])
        low = np.full(len(sizes), exchange.NO_DOC)
        np.minimum.at(low, place, np.concatenate([p[2] for p in parts]))
        flat = window_minima(texts, sizes, anchors, low, length)
        sizes = sizes - length + 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.cumsum(sizes) - sizes
        cut = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))
        value, text = flat[cut], owner[cut]
        start = cut - begins[text]
        end = np.append(cut[1:], len(flat)) - begins[text]
        first = np.searchsorted(text, np.arange(len(sizes)))
        count = np.bincount(text, minlength=len(sizes))
        ends = np.cumsum([len(p[0]) for p in parts])
        for (chunk, _), (number, _, docs, _, _), which in zip(asked, parts, np.split(place, ends[:-1]), strict=True):
            times = count[which]
            entry = np.repeat(np.arange(len(which)), times)
            run = _ranges(first[which], times)
            smaller = value[run] < docs[entry]
            if smaller.any():
                entry, run = entry[smaller], run[smaller]
                table, at = np.unique(value[run], return_inverse=True)
                yield chunk, pack(
                    np.diff(number[entry].astype(np.int64), prepend=0).astype(np.int32),
                    start[run].astype(np.uint32), end[run].astype(np.uint32), table, at.astype(np.uint32),
                )

    def finish(chunk: Chunk, buckets: int, told: list[tuple[int, bytes]]):
        segments = Segments(chunk, length)
        at = segments.first[segments.row] + segments.begin
        whole = segments.low[segments.group] < segments.docs
        starts, ends = [at[whole]], [at[whole] + segments.size[whole]]
        times = np.diff(np.append(segments.heads, len(segments.group)))
        cut = [payload for bucket, payload in told if bucket >= buckets]
        runs = [unpack(payload) for bucket, payload in told if bucket < buckets]
        if cut:
            member, offset, low = told_windows(chunk, segments, cut)
            member, offset = member[low < segments.docs[member]], offset[low < segments.docs[member]]
            starts.append(at[member] + offset)
            ends.append(at[member] + offset + length)
        if runs:
            group = np.concatenate([np.cumsum(steps, dtype=np.int64) for steps, *_ in runs])
            begin, end = (np.concatenate([run[i] for run in runs]).astype(np.int64) for i in (1, 2))
            low = np.concatenate([table[place] for *_, table, place in runs])
            repeat = times[group]
            answer = np.repeat(np.arange(len(group)), repeat)
            member = _ranges(segments.heads[group], repeat)
            gone = low[answer] < segments.docs[member]
            answer, member = answer[gone], member[gone]
            starts.append(at[member] + begin[answer])
            ends.append(at[member] + end[answer] + (length - 1))
        cover = covered(np.concatenate(starts), np.concatenate(ends), segments.total)
        kept, removed, spans = [], [], []
        for text, first in zip(chunk.texts, segments.first.tolist(), strict=True):
            mask = cover[first:first + len(text)]
            removed.append(int(mask.sum()))
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if removed[-1] else text)
        return (
            pa.array(kept, pa.binary()),
            pa.array([len(t) for t in chunk.texts], pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(spans, pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        )

    return exchange.Rounds(ask, answer, ask_again, answer_again, finish)


def without_repeats(
    docs: DataFrame, length: int = LENGTH,
    chunk_bytes: int = exchange.CHUNK_BYTES, bucket_bytes: int = exchange.BUCKET_BYTES,
) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the bytes that repeat from smaller doc_ids.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a
    smaller doc_id. Windows meet in the shard of their smallest anchor; anchors that
    one document alone has are left out first. Distinct segments are sorted into suffix
    arrays of SHARD_BYTES, whole anchors each, and equal windows are grouped by permuted
    common prefixes. An anchor with more than HOT_BYTES of distinct segments has its
    windows dealt by their content instead, where equal windows meet as equal bytes.

    Every column but ``text`` is kept; ``_found`` holds kept (bytes), n_bytes, n_removed,
    n_spans and kept_sha256. Null text is empty. A missing doc_id counts as larger
    than all others, so such rows are never a reference for others; rows with equal
    doc_id do not shorten each other.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    return exchange.run(
        docs, rounds(length),
        "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        chunk_bytes, bucket_bytes,
    )


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what is left as the text, all other columns kept; n_chars is counted anew.

    A character whose bytes were cut apart is dropped from the text.
    """

    @F.arrow_udf("string")
    def characters(kept: pa.Array) -> pa.Array:
        release()
        return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())

    found = without_repeats(packed(docs, "doc_id", "text"), length)
    texts = unpacked(found.withColumn("text", characters("_found.kept")), docs.columns, "doc_id", "text")
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return texts


def report(docs: DataFrame, **sizes: int) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"), **sizes)
    return found.select("doc_id", "_found.n_bytes", "_found.n_removed", "_found.n_spans", "_found.kept_sha256")


SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, p, substring(h, 2 * p + 1, {2 * (1000 + LENGTH - 1)}) as part
      from (select doc_id, h, unnest(range(0, len(h) // 2, 1000)) as p from d)),
s as (select doc_id, p + j as i, substring(part, 2 * j + 1, {2 * LENGTH}) as gram
      from (select *, unnest(range(0, least(1000, len(part) // 2 - {LENGTH - 1}))) as j from c)),
m as (select gram, min(doc_id) as low from s group by gram having min(doc_id) <> max(doc_id)),
r as (select doc_id, i from s join m using (gram) where low < doc_id),
n as (select *, i - coalesce(lag(i) over (partition by doc_id order by i), -{LENGTH} - 1) > {LENGTH} as apart from r),
t as (select *, sum(apart::int) over (partition by doc_id order by i) as span from n),
p as (select doc_id, span, min(i) as a, max(i) + {LENGTH} as b from t group by doc_id, span),
g as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from p),
k as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail,
        list({{'since': since, 'a': a}} order by a) as parts from g group by doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(array_to_string(list_transform(parts, lambda x: substring(h, 2 * x.since + 1, 2 * (x.a - x.since))), ''), '')
         || substring(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from d left join k using (doc_id)
"""
