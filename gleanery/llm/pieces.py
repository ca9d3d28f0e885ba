"""SentencePiece models run by the tokenizers library, checked against SentencePiece itself."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence, Sized
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, functions as F

from gleanery.llm.common import bounded_batches, packed, release

MODEL = "piece_bpe_32k.model"
MODEL_FOLDER = "/opt/tokenizers"
THREADS = 2                    # of one encode call; the cores a task may use
BATCH_BYTES = 1 << 18          # text encoded at once; bounds what the library holds
WORD_LETTERS = 1 << 22         # letters of the words whose ids are kept for the next texts, and a batch more

# fixed values of the format
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


def parse(content: bytes):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(content)
    return model


def build(content: bytes):
    """A tokenizers.Tokenizer with the normaliser, pieces and byte fallback of a model file.

    Unigram models keep their scores. BPE models have scores too, but they rank
    merges: every split of a piece into two pieces is a merge, by falling score.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse(content)
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    unknown = model.trainer_spec.unk_id
    fallback = model.trainer_spec.byte_fallback
    if model.trainer_spec.model_type == UNIGRAM:
        core = models.Unigram([(piece, score) for piece, score, _ in pieces], unknown, fallback)
    elif model.trainer_spec.model_type == BPE:
        vocabulary = {piece: i for i, (piece, _, _) in enumerate(pieces)}
        plain = {piece for piece, _, kind in pieces if kind == NORMAL}
        merges = sorted(
            (-score, i, vocabulary[piece[:cut]], piece[:cut], piece[cut:])
            for i, (piece, score, kind) in enumerate(pieces) if kind == NORMAL
            for cut in range(1, len(piece))
            if piece[:cut] in plain and piece[cut:] in plain
        )
        core = models.BPE(
            vocabulary, [(left, right) for _, _, _, left, right in merges],
            unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=fallback,
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    spec, steps = model.normalizer_spec, []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    inner = re.compile(f"[^{MARK}]{MARK}")
    if not any(inner.search(piece) for piece, _, kind in pieces if kind in (NORMAL, USER_DEFINED)):
        # no piece runs across a mark, so words are encoded one by one, in bounded memory
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    # marks are replaced once in the joined text, which differs only where bytes spell the mark: see exact_decoder
    tokenizer.decoder = decoders.Sequence(
        [decoders.ByteFallback(), decoders.Fuse(), decoders.Metaspace(MARK, "never"), *_strip(spec)]
    )
    return tokenizer


def _strip(spec) -> list:
    from tokenizers import decoders

    return [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []


def exact_decoder(content: bytes):
    """Decoder that replaces marks piece by piece, so a mark that byte pieces spell stays."""
    from tokenizers import decoders

    return decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *_strip(parse(content).normalizer_spec)]
    )


class Pieces:
    """Both libraries over one model file."""

    def __init__(self, content: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.threads = threads
        self.tokenizer = build(content)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.exact = exact_decoder(content)
        kinds = parse(content).pieces
        self.unknown = {i for i, piece in enumerate(kinds) if piece.type == UNKNOWN}
        self.control = {i for i, piece in enumerate(kinds) if piece.type == CONTROL}
        self.surface = parse(content).trainer_spec.unk_surface
        spelling = {f"<0x{byte:02X}>" for byte in MARK.encode()}
        self.mark_bytes = {i for i, piece in enumerate(kinds) if piece.type == BYTE and piece.piece in spelling}
        spec = parse(content).normalizer_spec
        changes = spec.precompiled_charsmap or spec.remove_extra_whitespaces
        self.by_word = (
            self.tokenizer.pre_tokenizer is not None and spec.add_dummy_prefix and spec.escape_whitespaces and not changes
        )
        self.watched = np.zeros(len(kinds), bool)
        self.watched[sorted(self.unknown | self.control | self.mark_bytes)] = True
        self.starts = np.array([piece.piece.startswith(MARK) for piece in kinds])
        self.forget()

    def forget(self) -> None:
        """Keep no words."""
        self.known: dict[str, int] = {}             # numbers of words
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)      # of all their ids, in order
        self.letters = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of ``words``: those of one text of them all, cut where a piece starts with a mark."""
        ids = np.array(self._whole([" ".join(words)])[0], np.int32)
        ends = np.append(np.flatnonzero(self.starts[ids]), len(ids))
        if len(ends) == len(words) + 1 and ends[0] == 0:
            ends = ends[1:]
        else:                                       # a word whose pieces do not tell where it starts
            found = self._whole(words)
            ids = np.array(list(chain.from_iterable(found)), np.int32)
            ends = np.cumsum([len(f) for f in found])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ends = np.concatenate([self.ends, ends + self.ends[-1]])
        self.ids = np.concatenate([self.ids, ids])
        self.letters += sum(map(len, words))

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with single spaces, each distinct word looked up once and encoded once as long as it is kept."""
        if self.letters > WORD_LETTERS:
            self.forget()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(distinct[new].tolist())
        number = number[words.indices.to_numpy()]
        starts, sizes = self.ends[number], self.ends[number + 1] - self.ends[number]
        upto = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        return np.split(ids, upto[split.offsets.to_numpy()[1:-1]])

    def _single(self, text: str) -> bool:
        """The text can be put together from words."""
        return self.by_word and text != "" and text[0] != " " != text[-1] and "  " not in text and MARK not in text

    def encode_arrays(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity): the tokenizers library's ids, and whether SentencePiece gives the same.

        The model sees one word at a time, and the prefix makes a word after one space the same as a text of its
        own: texts with single spaces are put together from words. SentencePiece encodes every text as a whole;
        where its ids differ, the tokenizers library encodes the whole text too, and that counts.
        """
        theirs = self.judge.encode(texts, num_threads=self.threads, return_type="numpy")
        single = [at for at, text in enumerate(texts) if self._single(text)]
        out: list = [None] * len(texts)
        if single:
            for at, ids in zip(single, self._by_words([texts[at] for at in single]), strict=True):
                if np.array_equal(ids, theirs[at]):
                    out[at] = (ids, True)
        rest = [at for at, row in enumerate(out) if row is None]
        for at, found in zip(rest, self._whole([texts[at] for at in rest]), strict=True):
            ids = np.array(found, np.int32)
            out[at] = (ids, np.array_equal(ids, theirs[at]))
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """(ids, parity) of ``encode_arrays``."""
        return [(ids.tolist(), same) for ids, same in self.encode_arrays(texts)]

    def decode(self, ids: Sequence[Sequence[int] | np.ndarray]) -> list[str]:
        """Texts of the ids by the tokenizers library.

        As in SentencePiece, control ids stand for nothing and unknown ids for a fixed string.
        """
        arrays = [np.asarray(row, np.int64) for row in ids]
        lists = [row.tolist() for row in arrays]
        texts = self.tokenizer.decode_batch(lists, skip_special_tokens=False)
        special = self.unknown | self.control
        for at, row in enumerate(lists):
            if not self.watched.take(arrays[at], mode="clip").any():
                continue
            if not special.isdisjoint(row) or self.mark_bytes.issubset(row):
                pieces = [self.surface if i in self.unknown else self.tokenizer.id_to_token(i) for i in row if i not in self.control]
                texts[at] = self.exact.decode(pieces)
        return texts

    def checked(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round_trip): as ``encode_arrays``, and whether the ids decode to the text."""
        found = self.encode_arrays(texts)
        back = self.decode([ids for ids, _ in found])
        return [(ids, same, text == again) for (ids, same), text, again in zip(found, texts, back, strict=True)]


@lru_cache(maxsize=4)
def _pieces(content: bytes, threads: int) -> Pieces:
    return Pieces(content, threads)


def groups(texts: Iterable[Sized]) -> Iterator[list]:
    """Texts, or lists of ids, in runs of ``BATCH_BYTES`` and at most one more."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_model(path: str | None = None) -> bytes:
    with open(path or os.path.join(MODEL_FOLDER, MODEL), "rb") as file:
        return file.read()


def encoded_batches(
    pieces: Pieces, batches: Iterable[pa.Array], ids: bool = True, keep_words: bool = False
) -> Iterator[pa.Array]:
    """Structs of ``encoded`` for the texts of a task; without ``keep_words`` its words go when it ends."""
    try:
        for texts in batches:
            release()
            lists, sizes, digests, parity, same = [], [], [], [], []
            for group in groups([t or "" for t in texts.to_pylist()]):
                for array, agree, back in pieces.checked(group):
                    lists.append(array if ids else None)
                    sizes.append(len(array))
                    digests.append(hashlib.sha256(array.astype("<i4").tobytes()).hexdigest())
                    parity.append(agree)
                    same.append(back)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(lists, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(parity, pa.bool_()), pa.array(same, pa.bool_()),
                ],
                names=["ids", "n_tokens", "ids_sha256", "parity", "round_trip"],
            )
    finally:
        if not keep_words:      # where earlier steps left more workers than tasks, which take turns
            pieces.forget()
            release()


def encoded(
    docs: DataFrame, path: str | None = None, threads: int = THREADS, ids: bool = True, keep_words: bool = True
) -> DataFrame:
    """``docs`` (text, ...) with struct ``_encoded``: ids, n_tokens, ids_sha256, parity, round_trip.

    The ids are the tokenizers library's. parity: SentencePiece gives the same ids.
    round_trip: the tokenizers library decodes the ids to the text. ids_sha256 is over little-endian 32-bit ids; ``ids=False``
    leaves the ids themselves null. Null and empty texts have no ids. The driver reads
    the model file and sends its bytes, so executors need no copy of it.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))  # one model file, whatever the input

    @F.arrow_udf("struct<ids:array<int>,n_tokens:bigint,ids_sha256:string,parity:boolean,round_trip:boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encoded_batches(_pieces(shared.value, threads), batches, ids, keep_words)

    return docs.withColumn("_encoded", encode("text"))


def tokenized(
    docs: DataFrame, path: str | None = None, threads: int = THREADS,
    checks: bool = False, seen: Observation | None = None,
) -> DataFrame:
    """``docs`` with their ids and number of tokens in place of the text; other columns are kept.

    Every text is checked as in ``encoded``. With ``checks`` the columns parity and
    round_trip stand beside the ids; ``seen`` counts the rows, and those without parity
    and without round trip, whenever the result is computed. A column that has the name
    of a new one is replaced.
    """
    found = encoded(packed(docs, "text"), path, threads, keep_words=False)
    if seen is not None:
        found = found.observe(
            seen, F.count(F.lit(1)).alias("rows"),
            F.count_if(~F.col("_encoded.parity")).alias("no_parity"),
            F.count_if(~F.col("_encoded.round_trip")).alias("no_round_trip"),
        )
    added = ["n_tokens", "ids", *(["parity", "round_trip"] if checks else [])]
    kept = [c for c in docs.columns if c not in ("text", *added)]
    return found.select(
        *[F.col(f"_rest.`{c}`").alias(c) for c in kept],
        *[F.col(f"_encoded.{c}").alias(c) for c in added],
    )


def decoded(encodings: DataFrame, path: str | None = None, threads: int = THREADS) -> DataFrame:
    """``encodings`` (ids, ...) with ``_text``, what the ids decode to; null for null ids, empty for none."""
    bounded_batches(encodings.sparkSession)
    shared = encodings.sparkSession.sparkContext.broadcast(read_model(path))

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        pieces = _pieces(shared.value, threads)
        texts = [text for group in groups(ids.as_py() or [] for ids in lists) for text in pieces.decode(group)]
        return pa.array([t if ids.is_valid else None for ids, t in zip(lists, texts, strict=True)], pa.string())

    return encodings.withColumn("_text", decode("ids"))


def report(docs: DataFrame) -> DataFrame:
    return encoded(docs.select("doc_id", "text"), ids=False).select(
        "doc_id", "_encoded.n_tokens", "_encoded.ids_sha256", "_encoded.parity", "_encoded.round_trip"
    )
