import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Observation
from sentencepiece import sentencepiece_model_pb2

from gleanery.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_tokens int, _encoded int"
TEXTS = [
    "", " ", "  two  spaces ", "a\n\nb\tc\r\n", "▁mark", "in▁side", "🙂 é́ 日本語 ﬁ ²", "<s> </s> <unk> <0x41>", "\x00 \x7f",
    "word " * 3000, "x" * 5000, " " * 50, "The quick brown fox.",
]


def unigram(**spec):
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    for name, value in spec.items():
        setattr(model.normalizer_spec, name, value)
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    rows += [("▁", -3, 1), ("▁the", -2, 1), ("the", -4, 1), ("t", -6, 1), ("h", -6, 1), ("e", -5, 1), ("an", -4, 1), ("▁an", -3, 1), ("d", -6, 1), ("▁quick", -7, 1), ("q", -8, 1), ("n", -6, 1)]
    for piece, score, kind in rows:
        entry = model.pieces.add()
        entry.piece, entry.score, entry.type = piece, score, kind
    return model.SerializeToString()


@pytest.fixture(scope="module")
def given():
    return pieces.Pieces(pieces.read_model())


def test_ids_are_those_of_the_other_library(given):
    judge = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    found = given.encode(TEXTS)
    assert [i for i, _ in found] == judge.encode(TEXTS) and all(same for _, same in found)
    back = given.decode([i for i, _ in found])
    assert [a == b or "▁" in a for a, b in zip(TEXTS, back)] == [True] * len(TEXTS)


@pytest.mark.parametrize("letters", [pieces.WORD_LETTERS, 5])
def test_words_are_encoded_once_while_they_are_kept(monkeypatch, letters):
    monkeypatch.setattr(pieces, "WORD_LETTERS", letters)
    for content in (pieces.read_model(), unigram(add_dummy_prefix=True, escape_whitespaces=True)):
        both, sent = pieces.Pieces(content), []
        real = both.tokenizer

        class Recorder:
            def encode_batch_fast(self, texts, **how):
                sent.extend(texts)
                return real.encode_batch_fast(texts, **how)

        both.tokenizer = Recorder()
        texts = [*TEXTS, " lead", "trail ", "zebra", "the zebra\nand zebra é日本 zebra", "a \t b", "é é"]
        for given in (texts, [], [""], texts[::-1], texts * 2):
            assert [i for i, _ in both.encode(given)] == [real.encode(t, add_special_tokens=False).ids for t in given]
        if letters > 5 and content == pieces.read_model():       # the other one's libraries differ, so it sees whole texts too
            assert " ".join(sent).split(" ").count("zebra") == 1


def test_each_distinct_word_of_a_batch_is_looked_up_once():
    both, asked = pieces.Pieces(pieces.read_model()), []

    class Recorder(dict):
        def get(self, word, other=None):
            asked.append(word)
            return super().get(word, other)

        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    both.known = Recorder()
    texts = ["the zebra " * 300 + "end", "the", "zebra\nand zebra"]
    for count in (1, 2):                # unknown and known
        assert [i for i, _ in both.encode(texts)] == [both.tokenizer.encode(t).ids for t in texts]
        assert asked.count("zebra") == asked.count("the") == count
    assert sorted(both.known.values()) == list(range(len(both.known))) and len(both.ends) == len(both.known) + 1


def test_a_worker_keeps_no_words_of_a_task(given):
    batches = [pa.array([*TEXTS, None]), pa.array([], pa.string()), pa.array(["The zebra."])]
    kept, found = [], []
    for batch in pieces.encoded_batches(given, batches):
        kept.append(len(given.known))
        found += batch.field("ids").to_pylist()
    assert found == [i for i, _ in given.encode([*TEXTS, "", "The zebra."])]
    given.forget()
    assert kept[0] and kept[2] > kept[0]
    task = pieces.encoded_batches(given, iter(batches))
    assert next(task) and given.known
    task.close()
    assert not given.known and len(given.ids) == 0 and given.letters == 0
    assert list(pieces.encoded_batches(given, batches)) and not given.known
    assert list(pieces.encoded_batches(given, [])) == []


def test_decoding_equals_replacing_marks_piece_by_piece(given):
    dice = np.random.default_rng(4)
    token = given.tokenizer.token_to_id
    mark = [token(f"<0x{byte:02X}>") for byte in "▁".encode()]
    rows = [dice.integers(3, given.tokenizer.get_vocab_size(), dice.integers(0, 30)).tolist() for _ in range(300)]
    rows += [mark, [*mark, token("▁the")], [token("▁the"), *mark], [token("▁"), *mark, token("▁")], mark[:2], [*reversed(mark)]]
    rows += [[*dice.choice(mark, 8).tolist(), token("▁a")] for _ in range(50)]
    exact = pieces.exact_decoder(pieces.read_model())
    assert given.decode(rows) == [exact.decode([given.tokenizer.id_to_token(i) for i in row]) for row in rows]


def test_stored_ids_decode_in_groups(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_BYTES", 5)
    given = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    ids = pieces.tokenized(given)
    stored = spark.createDataFrame([*[tuple(r) for r in ids.collect()], (99, None, None)], ids.schema)
    back = {r.doc_id: r._text for r in pieces.decoded(stored).collect()}
    assert back == {**{i: t.replace("▁", " ") for i, t in enumerate(TEXTS)}, len(TEXTS): "", 99: None}


@pytest.mark.parametrize("extra", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_unigram_models(extra, prefix):
    both = pieces.Pieces(unigram(add_dummy_prefix=prefix, remove_extra_whitespaces=extra, escape_whitespaces=True))
    texts = ["the and", " the  quick ", "", "then é", "quick\nthe"]
    found = both.encode(texts)
    assert all(same for _, same in found)
    assert [i for i, _ in found] == both.judge.encode(texts)


def test_other_models_are_refused():
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 3
    with pytest.raises(ValueError):
        pieces.build(model.SerializeToString())


def test_report_and_tokenized(spark, given):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (0, ""), (0, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    expected = [(i, given.encode([t or ""])[0][0]) for i, t in rows]
    report = pieces.report(docs).collect()
    digest = [(i, len(n), hashlib.sha256(np.array(n, "<i4").tobytes()).hexdigest(), True) for i, n in expected]
    assert sorted([tuple(r)[:4] for r in report], key=str) == sorted(digest, key=str)
    table = pieces.tokenized(docs)
    assert table.columns == ["doc_id", "_encoded", "n_tokens", "ids"]
    assert sorted(str((r.doc_id, r.ids)) for r in table.collect()) == sorted(map(str, expected))
    back = pieces.decoded(table).collect()
    assert all(r._text == (TEXTS[r.doc_id] if r.doc_id is not None else "") for r in back if r.doc_id is None or "▁" not in TEXTS[r.doc_id])
    assert pieces.report(docs.where("false")).count() == 0


def test_a_wrong_decoder_is_seen():
    from tokenizers import decoders

    both = pieces.Pieces(unigram(add_dummy_prefix=True, escape_whitespaces=True))
    assert [c[1:] for c in both.checked(["the and", "é"])] == [(True, True)] * 2
    both.tokenizer.decoder = decoders.Fuse()
    assert [c[1:] for c in both.checked(["the and", "é"])] == [(True, False)] * 2


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import normalizers

    both = pieces.Pieces(unigram(add_dummy_prefix=True, escape_whitespaces=True))
    both.tokenizer.normalizer = normalizers.Replace(" ", "▁")     # without the prefix
    (ids, parity), = both.encode(["the"])
    assert ids == both.tokenizer.encode("the").ids != both.judge.encode("the") and not parity


def test_unknown_and_control_ids_decode_as_in_the_other_library(given):
    for both in (given, pieces.Pieces(unigram(add_dummy_prefix=True, escape_whitespaces=True))):
        the = both.judge.encode("the and é")
        rows = [[], the, [1, *the, 2], [*the, 0, *the], [2, *the, 1, 1]]
        assert both.decode(rows) == [both.judge.decode(row) for row in rows]


def test_tokenized_keeps_and_counts_the_checks(spark):
    docs = spark.createDataFrame([(1, "The quick fox."), (2, "▁mark"), (3, None)], "doc_id long, text string")
    seen = Observation()
    rows = {r.doc_id: r for r in pieces.tokenized(docs, checks=True, seen=seen).collect()}
    assert {i: (r.parity, r.round_trip) for i, r in rows.items()} == {1: (True, True), 2: (True, False), 3: (True, True)}
    assert seen.get == {"rows": 3, "no_parity": 0, "no_round_trip": 1}
