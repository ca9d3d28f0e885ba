"""Collocations: frequent phrases scored by how much their parts attract each other."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gleanery.llm.common import release, staged
from gleanery.llm.trie import Trie

LEAST = 100              # occurrences of a candidate
LONGEST = 5              # words of a phrase
FIRST = 2000             # phrases returned for each language
BLOCK_WORDS = 1 << 20    # words of a block of text
PIECE_BYTES = 1 << 20    # text split into words at once
TRIE_PHRASES = 250_000   # candidates of one trie
KNOWN_PHRASES = 1_000_000    # hashes of shorter candidates, or frequent words, that are broadcast at most
TRIE_BYTES = 32 << 20    # of those words
HELD_WORDS = 1 << 22     # words of text whose phrases are counted before they are sent
BUCKET_WORDS = 1 << 21   # words of text a range of hashes is for; bounds what one group adds up

MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block long, lang string, words binary, codes binary, lead int, n long"
SOURCE_BITS = 32         # of a block's number, below that of the partition it comes from
SLICE = 512              # candidates whose counts travel together
COUNTS = "lang string, phrase binary, a long"
BORDER = b"\n"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
SPACED = bytes.maketrans(SEPARATORS + b"\t", BORDER * len(SEPARATORS) + b" ")


class _Codes(dict):
    """Numbers words as they come; the empty word is 0, a border 1."""

    def __init__(self):
        super().__init__({b"": 0, BORDER: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Buffer:
    """Words of one language that wait to fill a block.

    A block that ends inside a piece of text hands its last words to the next one
    (``lead``), so that phrases across the cut are seen once.
    """

    def __init__(self, lead: list[bytes] | None = None):
        self.codes, self.parts, self.size = _Codes(), [np.zeros(0, np.int32)], 0
        self.lead = len(lead or [])
        if lead:
            self.add(lead)

    def add(self, words: list[bytes]) -> None:
        numbers = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        numbers = numbers[numbers > 0]
        self.parts.append(numbers)
        self.size += len(numbers)

    def block(self) -> tuple[list[bytes], np.ndarray]:
        return list(self.codes)[2:], np.concatenate(self.parts) - 1

    def tail(self) -> list[bytes]:
        words, codes = self.block()
        last = codes[-(LONGEST - 1):]
        borders = np.flatnonzero(last == 0)
        return [words[c - 1] for c in (last[borders[-1] + 1:] if len(borders) else last)]


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with borders between pieces, a bounded part at a time."""
    spaced = text.lower().translate(SPACED)         # bytes: only A to Z change
    at = 0
    while at < len(spaced):
        cut = at + PIECE_BYTES
        if cut < len(spaced):
            ends = [e for e in (spaced.find(b" ", cut), spaced.find(BORDER, cut)) if e >= 0]
            cut = min(ends) if ends else len(spaced)
        yield spaced[at:cut].replace(BORDER, b" \n ").split(b" ")
        at = cut


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, first the lowest bytes of all and last the highest."""
    return zstandard.compress(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes(), 1)


def _loose(content: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(content), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _block_row(number: int, lang: str, words: list[bytes], codes: np.ndarray, lead: int, n: int) -> pa.RecordBatch:
    listed = zstandard.compress(BORDER.join(words), 1)          # no word holds a border
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]), pa.array([lang]), pa.array([listed], pa.binary()),
            pa.array([_squeezed(codes.astype("<i4"))], pa.binary()), pa.array([lead], pa.int32()), pa.array([n], pa.int64()),
        ],
        names=["block", "lang", "words", "codes", "lead", "n"],
    )


def word_blocks(texts: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, words, codes, lead, n): texts of a language as numbers of the block's own distinct words.

    Words and codes are compressed, as they are stored and read once a level.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Buffer] = {}
        number = itertools.count(TaskContext.get().partitionId() << SOURCE_BITS)

        def row(lang: str) -> pa.RecordBatch:
            words, codes = held[lang].block()
            n = int(np.count_nonzero(codes[held[lang].lead:]))
            return _block_row(next(number), lang, words, codes, held[lang].lead, n)

        total = 0
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0), column, strict=True):
                lang = lang.as_py()
                for words in _pieces(text.as_py()):
                    buffer = held.setdefault(lang, _Buffer())
                    before = buffer.size
                    buffer.add(words)
                    total += buffer.size - before
                    while total >= block_words:
                        full = max(held, key=lambda name: held[name].size)
                        if held[full].size < LONGEST:
                            break
                        yield row(full)
                        total -= held[full].size
                        held[full] = _Buffer(held[full].tail())
                        total += held[full].size
                if lang in held:
                    held[lang].add([BORDER])
                    total += 1
        for lang in sorted(held):
            yield row(lang)
        held.clear()
        release()

    chosen = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(chosen.mapInArrow(cut, BLOCKS))


@dataclass(frozen=True)
class _Block:
    number: int
    lang: str
    words: list[bytes]
    codes: np.ndarray
    lead: int
    n: int


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(len(batch)):
            number, lang, words, codes, lead, n = (batch.column(c)[i].as_py() for c in range(6))
            listed = zstandard.decompress(words)
            yield _Block(number, lang, listed.split(BORDER) if listed else [], _loose(codes, "<i4"), lead, n)


def _rows(langs: list[str], phrases: list[bytes], counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "a"]
    )


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def word_counts(blocks: DataFrame) -> DataFrame:
    def count(batches):
        for b in _blocks(batches):
            found = np.bincount(b.codes[b.lead:], minlength=len(b.words) + 1)[1:]
            seen = np.flatnonzero(found)
            yield _rows([b.lang] * len(seen), [b.words[i] for i in seen], found[seen])

    return blocks.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequent_words_only(blocks: DataFrame, frequent: DataFrame, limit: int) -> DataFrame:
    """Blocks whose other words are borders, as no candidate holds one; unchanged if ``limit`` words would not do."""
    size = frequent.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("phrase")).alias("bytes")).first()
    if size["n"] > limit or (size["bytes"] or 0) > TRIE_BYTES:
        return blocks
    held: dict[str, set[bytes]] = {}
    for row in frequent.select("lang", "phrase").collect():
        held.setdefault(row["lang"], set()).add(bytes(row["phrase"]))
    known = blocks.sparkSession.sparkContext.broadcast(held)

    def keep(batches):
        for b in _blocks(batches):
            own = known.value.get(b.lang, ())
            stay = [i for i, w in enumerate(b.words) if w in own]
            renamed = np.zeros(len(b.words) + 1, "<i4")
            renamed[np.array(stay, int) + 1] = np.arange(1, len(stay) + 1)
            yield _block_row(b.number, b.lang, [b.words[i] for i in stay], renamed[b.codes], b.lead, b.n)

    return staged(blocks.mapInArrow(keep, BLOCKS))


def _phrase_hashes(b: _Block, length: int) -> np.ndarray:
    """Hash of the phrase that starts at each position, whether or not it crosses a border."""
    seed = xxhash.xxh3_64_intdigest(b.lang.encode())
    one = np.array([0, *[xxhash.xxh3_64_intdigest(w, seed) for w in b.words]], np.uint64)[b.codes]
    out = one[: max(0, len(one) - length + 1)].copy()
    for k in range(1, length):
        out = (out ^ (out >> np.uint64(29))) * MIX + one[k:k + len(out)]
    return out


def _starts(b: _Block, length: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of phrases inside pieces; with ``shorter`` both parts one word shorter are in it."""
    hashes = _phrase_hashes(b, length)
    good = np.ones(len(hashes), bool)
    for k in range(length):
        good &= b.codes[k:k + len(hashes)] != 0
    good[: max(0, b.lead - length + 1)] = False
    place = np.flatnonzero(good)
    if shorter is not None and len(place):
        parts = _phrase_hashes(b, length - 1)
        place = place[_within(parts[place], shorter)]
        place = place[_within(parts[place + 1], shorter)]
    return place, hashes[place]


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _edges(buckets: int) -> np.ndarray:
    """First hash of each of ``buckets`` ranges of equal size."""
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def _hash_counts(blocks: DataFrame, length: int, shorter, buckets: int, held_words: int) -> DataFrame:
    """(bucket, source, hashes, n): how often each hash occurs in some blocks of a partition of ``word_blocks``.

    Hashes of a bucket are in order and stand as compressed differences, which take half of the bytes.
    """
    edges = _edges(buckets)

    def packed(source: int, hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(hashes), return_counts=True)
        cuts = [*np.searchsorted(found, edges).tolist(), len(found)]
        for at in range(0, buckets, SLICE):
            own = [i for i in range(at, min(at + SLICE, buckets)) if cuts[i] < cuts[i + 1]]
            parts = [slice(cuts[i], cuts[i + 1]) for i in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int32()), pa.array([source] * len(own), pa.int64()),
                    pa.array([_squeezed(np.diff(found[p], prepend=edges[i])) for i, p in zip(own, parts)], pa.binary()),
                    pa.array([_squeezed(n[p].astype("<u4")) for p in parts], pa.binary()),
                ],
                names=["bucket", "source", "hashes", "n"],
            )

    def count(batches):
        held, size, source = [], 0, None
        for b in _blocks(batches):
            if held and (size >= held_words or b.number >> SOURCE_BITS != source):
                yield from packed(source, held)
                held, size = [], 0
            source = b.number >> SOURCE_BITS
            held.append(_starts(b, length, None if shorter is None else shorter.value[0])[1])
            size += len(held[-1])
        if held:
            yield from packed(source, held)

    return blocks.mapInArrow(count, "bucket int, source long, hashes binary, n binary")


def _heavy_hashes(counted: DataFrame, buckets: int) -> DataFrame:
    """(h, source) of hashes that occur LEAST times or more, and a partition of ``word_blocks`` that has one.

    No frequent phrase is missed, unless two share a 64-bit hash, and few others are in.
    """
    edges = _edges(buckets)

    def add(part: pa.Table) -> pa.Table:
        first = edges[part.column("bucket")[0].as_py()]
        values = [first + np.cumsum(_loose(h.as_py(), "<u8"), dtype=np.uint64) for h in part.column("hashes")]
        sources = np.repeat(part.column("source").to_numpy(), [len(v) for v in values])
        values, n = np.concatenate(values), np.concatenate([_loose(c.as_py(), "<u4") for c in part.column("n")])
        order = np.argsort(values, kind="stable")
        values = values[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        seen = starts[np.add.reduceat(n[order].astype(np.int64), starts) >= LEAST]
        return pa.table({"h": values[seen].view(np.int64), "source": sources[order[seen]]})

    return staged(counted.groupBy("bucket").applyInArrow(add, "h long, source long"))


def _held(hashes: DataFrame):
    """Broadcast arrays of the hashes, in order, and of their sources."""
    found = hashes.select("h", "source").toArrow()
    values, owners = (found.column(c).to_numpy().astype(np.int64) for c in range(2))
    order = np.argsort(values.view(np.uint64))
    return hashes.sparkSession.sparkContext.broadcast((values.view(np.uint64)[order], owners[order]))


def _candidates(blocks: DataFrame, length: int, heavy) -> DataFrame:
    """(lang, phrase) of every hash of ``heavy``, from the partition that it names."""

    def find(batches):
        source, own = None, None
        for b in _blocks(batches):
            if b.number >> SOURCE_BITS != source:
                source = b.number >> SOURCE_BITS
                own = heavy.value[0][heavy.value[1] == source]
            if not len(own):
                continue
            place, hashes = _starts(b, length, None)
            good = _within(hashes, own)
            own = own[~_within(own, np.unique(hashes[good]))]       # found here, so not looked for any more
            first = place[good][np.unique(hashes[good], return_index=True)[1]]
            phrases = [b" ".join(b.words[c - 1] for c in b.codes[i:i + length]) for i in first]
            yield _rows([b.lang] * len(phrases), phrases, np.zeros(len(phrases), np.int64))

    return blocks.mapInArrow(find, COUNTS).select("lang", "phrase")


def _counted(blocks: DataFrame, trie) -> DataFrame:
    """The frequent ones of a broadcast trie's phrases, counted in its states by shards of text and summed."""

    def count(batches):
        own = trie.value
        total = np.zeros(len(own.check), np.int64)
        for b in _blocks(batches):
            place, state = own.walk(b.lang, own.symbols(b.words, b.codes))
            total += np.bincount(state[place + own.depth - 1 >= b.lead], minlength=len(total))
        found = total[own.leaf]
        for at in range(0, len(found), SLICE):
            if found[at:at + SLICE].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([found[at:at + SLICE].astype("<i8").tobytes()])], names=["at", "counts"]
                )

    def add(part: pa.Table) -> pa.Table:
        own, at = trie.value, part.column("at")[0].as_py()
        total = sum(np.frombuffer(c.as_buffer(), "<i8") for c in part.column("counts"))
        seen = np.flatnonzero(total >= LEAST)
        listed = [own.phrases[at + i] for i in seen]
        return pa.Table.from_batches([_rows([lang for lang, _ in listed], [phrase for _, phrase in listed], total[seen])])

    shards = blocks.mapInArrow(count, "at int, counts binary")
    return shards.groupBy("at").applyInArrow(add, COUNTS)


def frequent_phrases(
    blocks: DataFrame, *, limit: int = TRIE_PHRASES, known: int = KNOWN_PHRASES,
    bucket_words: int = BUCKET_WORDS, held_words: int = HELD_WORDS,
) -> DataFrame:
    """(lang, phrase, a, words) of every phrase of 1 to LONGEST words with LEAST occurrences.

    Level by level. Summed hash counts leave the candidates: phrases both of whose
    parts were candidates (where ``known`` of those can be broadcast; else all) and that
    are heavy themselves. Tries of at most about ``limit`` candidates each are
    broadcast in turn and count the text exactly.
    """
    frequent = staged(word_counts(blocks).where(F.col("a") >= LEAST))
    levels = [frequent.withColumn("words", F.lit(1))]
    text = frequent_words_only(blocks, frequent, known)
    buckets = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // bucket_words))
    shorter = None                              # level 2 needs no list: the text holds frequent words only
    for length in range(2, LONGEST + 1):
        heavy = _heavy_hashes(_hash_counts(text, length, shorter, buckets, held_words), buckets)
        n = heavy.count()
        shards = -(-n // limit)
        for shard in range(shards):
            hashes = _held(heavy.where(F.pmod("h", F.lit(shards)) == shard))
            listed = _candidates(text, length, hashes).distinct().toArrow()
            hashes.unpersist()
            pairs = list(zip(listed.column("lang").to_pylist(), listed.column("phrase").to_pylist(), strict=True))
            trie = text.sparkSession.sparkContext.broadcast(Trie(pairs))
            levels.append(staged(_counted(text, trie)).withColumn("words", F.lit(length)))
            trie.unpersist()
        if not n:
            break
        shorter = _held(heavy) if n <= known else None
    return reduce(DataFrame.unionByName, levels).withColumn("phrase", F.col("phrase").cast("string"))


def _part(first, count):
    return F.array_join(F.slice("listed", first, count), " ")


def collocations(documents: DataFrame, first: int = FIRST, *, block_words: int = BLOCK_WORDS, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 5 words.

    ``documents``: text, lang; a null text is empty and a null lang ``und``. Only A to Z
    are lower-cased. Every word of every text counts, also in texts of any length
    and in repeated rows. Numbers are exact: counts are longs and products have 38 digits.
    An empty table, or texts without a frequent phrase, give no row; other columns
    are ignored, whatever their names.
    """
    blocks = word_blocks(documents, block_words)
    every = staged(frequent_phrases(blocks, **how))
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    listed = every.where("words > 1").withColumn("listed", F.split("phrase", " "))
    cuts = listed.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "listed"
    ).select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words")).alias("rest"))
    heads = every.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = every.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr(
        "(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    )
    scored = (
        cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(sizes, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.col("words") - w + 1), lambda at: F.array_join(F.slice("listed", at, w), " ")
            ),
        )
    )
    within = (
        listed.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a")
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= first)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


SQL = f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
sizes as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (
  select lang, d, array_to_string(w[i:i + d - 1], ' ') as phrase, count(*) as a
  from (select lang, w, d, unnest(range(1, len(w) - d + 2)) as i from words, range(1, {LONGEST + 1}) as t(d) where len(w) >= d)
  group by all having count(*) >= {LEAST}),
candidates as (select *, string_split(phrase, ' ') as w from grams where d > 1),
cuts as (
  select c.lang, c.phrase, c.a, k, h.a as l, t.a as r, n, (1000::hugeint * c.a * n // (h.a::hugeint * t.a))::bigint as score
  from (select *, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest
        from (select *, unnest(range(1, d)) as k from candidates)) c
  join grams h on h.lang = c.lang and h.phrase = c.head join grams t on t.lang = c.lang and t.phrase = c.rest
  join sizes s on s.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
within as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, d - m + 2)) as i from (select *, unnest(range(2, d)) as m from candidates))
  group by all),
ranked as (
  select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank,
         b.phrase, b.a, l, r, n, score
  from best b left join within w on w.lang = b.lang and w.phrase = b.phrase where longer is null or longer < b.a)
select * from ranked where rank <= {FIRST}
"""
