import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleanery.llm import blocks, exchange, substrings, suffixes

SCHEMA = "doc_id long, text string, chunk int, rest string, _found int, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, 0) for i, t in rows], SCHEMA)


def large(i):
    return float("inf") if i is None else i


def brute_bytes(rows, length):
    low = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            low[s] = min(low.get(s, float("inf")), large(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if low[data[p:p + length]] < large(i):
                gone[p:p + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, window):
    low = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            s = tuple(w[p:p + window])
            low[s] = min(low.get(s, float("inf")), large(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p:p + window])] < large(i):
                gone[p:p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, count=60):
    dice = random.Random(seed)
    words = ["a", "bb", "ccc", "dé", "e\tf", " ", "gg\n", "ñandú"]
    passages = [" ".join(dice.choices(words, k=dice.randint(5, 60))) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, " \t\r\n"), (None, passages[0]), (3, "x" * 400), (4, "y" + "x" * 90)]
    for i in range(count):
        parts = [dice.choice([dice.choice(passages), " ".join(dice.choices(words, k=dice.randint(0, 20)))]) for _ in range(3)]
        rows.append((dice.randint(5, 60), dice.choice([" ", ""]).join(parts)))
    return [*rows, *rows[-5:]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("size", [700, 1 << 22])
def test_bytes_equal_brute_force(spark, seed, size):
    rows = corpus(seed)
    found = substrings.report(docs_of(spark, rows), chunk_bytes=size, bucket_bytes=size)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_bytes(rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("size", [700, 1 << 22])
def test_words_equal_brute_force(spark, seed, size):
    rows = corpus(seed)
    found = blocks.report(docs_of(spark, rows), chunk_bytes=size, bucket_bytes=size)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_words(rows, 13)


@pytest.mark.parametrize("module", [blocks, substrings])
def test_no_rows(spark, module):
    assert module.report(docs_of(spark, [])).count() == 0


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(exchange, "PIECE_BYTES", 100)
    rows = [(i, t) for i, t in corpus(5, 20) if i is not None]
    rows = sorted(rows, key=lambda r: (r[0], (r[1] or "").encode()))
    chunk = exchange.Chunk(np.array([i for i, _ in rows]), [(t or "").encode() for _, t in rows], np.arange(len(rows)))
    for module, brute, size in ((substrings, brute_bytes, 50), (blocks, brute_words, 13)):
        step = module.rounds(size)
        asked = {}
        for bucket, payload in step.ask(chunk, 3):
            asked.setdefault(bucket, []).append((0, payload))
        told = [(b, p) for b, sent in asked.items() for _, p in step.answer(sent)]
        again = {}
        for bucket, payload in step.ask_again(chunk, 3, told):
            again.setdefault(bucket, []).append((0, payload))
        told = [(b, p) for b, sent in again.items() for _, p in step.answer_again(sent)]
        columns = [c.to_pylist() for c in step.finish(chunk, 3, told)][1:]
        found = sorted([(int(i), *r) for i, r in zip(chunk.docs, zip(*columns))], key=str)
        assert found == brute(rows, size)


def test_cleaned_keeps_columns_and_whole_characters(spark):
    rows = [(1, "é" * 40), (2, "xxé" + "é" * 40 + "yy"), (3, None)]
    found = {r.doc_id: r for r in substrings.cleaned(docs_of(spark, rows)).collect()}
    assert found[1].text == "é" * 40 and found[1].n_chars == 40 and found[1]._found == 2 and found[1].chunk == 1
    assert found[2].text == "xxyy" and found[2].rest == "r" and found[3].text == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.booleans())
def test_suffix_array_and_prefixes(letters, arrays):
    text = np.array([*letters, 0])
    induce = suffixes._induce_lists
    if arrays:
        suffixes._induce_lists = suffixes._induce_arrays
    try:
        array = suffixes.suffix_array(text, 5)
    finally:
        suffixes._induce_lists = induce
    whole = text.tolist()
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    assert array.tolist() == order
    prefixes = suffixes.permuted_prefixes(text, array)
    for a, b in zip(order, order[1:]):
        k = 0
        while whole[a + k] == whole[b + k]:
            k += 1
        assert prefixes[b] == k


def in_process(rows, chunks, buckets, length=50):
    """The rounds of removal without Spark: n_removed by document."""
    steps = substrings.rounds(length)
    parts = [[(i, t.encode()) for i, t in rows[c::chunks]] for c in range(chunks)]
    parts = [exchange.Chunk(np.array([i for i, _ in p]), [t for _, t in p], np.arange(len(p))) for p in parts]

    def dealt(pairs):
        out = {}
        for to, sender, payload in pairs:
            out.setdefault(to, []).append((sender, payload))
        return out

    def turn(ask, answer):
        asked = dealt((b, c, p) for c in range(chunks) for b, p in ask(c))
        return dealt((c, b, p) for b, found in asked.items() for c, p in answer(found))

    first = turn(lambda c: steps.ask(parts[c], buckets), steps.answer)
    second = turn(lambda c: steps.ask_again(parts[c], buckets, first.get(c, [])), steps.answer_again)
    done = [steps.finish(parts[c], buckets, second.get(c, [])) for c in range(chunks)]
    return {i: r for p, d in zip(parts, done) for i, r in zip(p.docs.tolist(), d[2].to_pylist())}


def shared_passage(count):
    dice = random.Random(4)
    letters = [chr(c) for c in range(33, 127)]
    passage = "".join(dice.choices(letters, k=90))
    return [(i, "".join(dice.choices(letters, k=40)) + passage + "".join(dice.choices(letters, k=40))) for i in range(count)]


def test_a_passage_with_many_contexts_is_split(monkeypatch):
    sizes, plain = [], substrings.suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda text, size: sizes.append(len(text)) or plain(text, size))
    monkeypatch.setattr(substrings, "HOT_BYTES", 4000, raising=False)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000, raising=False)
    rows = shared_passage(1500)
    found = in_process(rows, 3, 1)
    assert found == {i: gone for i, _, gone, _, _ in brute_bytes(rows, 50)}
    assert min(n for i, n in found.items() if i) >= 90
    assert max(sizes, default=0) <= 8001


@pytest.mark.parametrize(("hot", "shard"), [(0, 1), (300, 200), (2000, 1 << 22)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_anchors_equal_brute_force(monkeypatch, seed, hot, shard):
    monkeypatch.setattr(substrings, "HOT_BYTES", hot)
    monkeypatch.setattr(substrings, "PLAIN_BYTES", min(hot, 256))
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    rows = [(n if seed == 3 else i, t) for n, (i, t) in enumerate(corpus(seed)) if i is not None]
    rows += [(i + 7, t) for i, t in shared_passage(20)] + [(90, "x" * 700 + "\0" * 80), (91, "x" * 60 + "\0" * 60)]
    rows = [(1000 * n + i if seed != 3 else n, t) for n, (i, t) in enumerate(rows)]
    expected = {i: gone for i, _, gone, _, _ in brute_bytes(rows, 50)}
    assert in_process(rows, 4, 3) == expected


def thue_morse(length, swap=False):
    """Two letters in the order that cancels in any polynomial hash modulo a power of two."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(length))


@pytest.mark.parametrize("length", [8, 16, 64, 1024, 4096])
def test_long_words_of_two_letters_are_told_apart(spark, length):
    same = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*same, thue_morse(length)])), (2, " ".join([*same, thue_morse(length, swap=True)]))]
    assert {r["doc_id"]: r["n_removed"] for r in blocks.report(docs_of(spark, rows)).collect()} == {1: 0, 2: 0}


def test_words_of_two_letters_equal_brute_force(spark):
    draw = random.Random(3)
    words = [thue_morse(n, swap) for n in (1, 2, 7, 8, 9, 64, 1024) for swap in (False, True)] + ["\x00", "\x00\x00", "é" * 4, "é" * 5]
    rows = [(i, " ".join(draw.choice(words) for _ in range(60)) if i % 3 else " ".join(words * 2)) for i in range(40)]
    rows = [(i, t.replace(" ", "  ", 1) + " " + rows[(i * 7) % 40][1][:9000]) for i, t in rows]
    found = blocks.report(docs_of(spark, rows))
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_words(rows, 13)


def test_names_of_suffixes_are_not_sorted_in_plain_loops(monkeypatch):
    def loops(*_):
        raise AssertionError("plain loops over a large text")

    monkeypatch.setattr(suffixes, "_induce_lists", loops)
    dice = np.random.default_rng(1)
    text = np.append(dice.integers(1, 90, (2000, 9))[dice.integers(0, 2000, 3000)].ravel(), 0)
    array = suffixes.suffix_array(text, 90)
    whole = text.tolist()
    assert array.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:i + 1200])


def test_windows_of_a_hot_anchor_go_to_few_buckets(monkeypatch):
    monkeypatch.setattr(substrings, "HOT_BYTES", 4000)
    monkeypatch.setattr(substrings, "PART_BYTES", 20_000, raising=False)
    rows = shared_passage(1500)
    chunk = exchange.Chunk(np.array([i for i, _ in rows]), [t.encode() for _, t in rows], np.arange(len(rows)))
    steps, buckets, told, held = substrings.rounds(50), 8, [], 0
    for bucket, payload in steps.ask(chunk, buckets):
        told += [(bucket, answer) for _, answer in steps.answer([(0, payload)])]
        held += int(exchange.unpack(payload)[2].sum())
    sent = [bucket for bucket, _ in steps.ask_again(chunk, buckets, told) if bucket >= buckets]
    assert sent and len(sent) == len(set(sent)) <= held // 4000 + held // 20_000
