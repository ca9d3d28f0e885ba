import random
import re
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import phrases
from gleanery.llm.trie import Trie

SCHEMA = "text string, lang string, a long, n string, phrase int"


def brute(rows, least=phrases.LEAST, first=phrases.FIRST):
    """The contract, word by word."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for d in range(1, 6):
                for i in range(len(words) - d + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + d])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in candidates.items():
            held = any(
                len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()
            )
            if not held:
                score, k = min((1000 * a * sizes[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(listed)[:first]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in rows], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(frame, **how).collect())


def sample(seed, documents=60):
    draw = random.Random(seed)
    vocabulary = [*"abcdefg", "New", "york", "É", "x y", "\x1c", "ü"]
    fixed = ["new York times square now", "a b a b a", "É ü É"]
    rows = []
    for _ in range(documents):
        words = [draw.choice([draw.choice(vocabulary), *fixed[:draw.randint(1, 3)]]) for _ in range(60)]
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "?!", " , "]) for w in words)
        rows.append((text, draw.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("how", [{}, {"block_words": 300}, {"limit": 40, "known": 30}, {"block_words": 50, "limit": 60, "known": 0}])
def test_equals_brute_force(spark, how):
    rows = sample(1)
    expected = brute(rows)
    assert expected and max(len(r[2].split(" ")) for r in expected) == 5
    assert found(spark, rows, **how) == expected


@pytest.mark.parametrize("how", [{"bucket_words": 500}, {"block_words": 100, "bucket_words": 90, "held_words": 150}])
def test_hashes_counted_in_buckets_equal_brute_force(spark, how):
    rows = sample(5)
    assert found(spark, rows, **how) == brute(rows)


def test_stored_blocks_and_sent_hashes_are_small(spark):
    draw = random.Random(2)
    texts = [(" ".join(f"word{int(draw.paretovariate(0.7))}" for _ in range(2000)), "en") for _ in range(40)]
    blocks = phrases.word_blocks(spark.createDataFrame(texts, "text string, lang string").coalesce(1))
    stored = blocks.selectExpr("octet_length(words) + octet_length(codes) as size", "n").agg({"size": "sum", "n": "sum"}).first()
    assert stored["sum(n)"] == 80_000 and stored["sum(size)"] < 4 * 80_000      # four bytes a code and more before
    counted = phrases._hash_counts(blocks, 2, None, 3, 1 << 20).collect()
    hashes = [phrases._loose(r["hashes"], "<u8") for r in counted]
    sent = sum(len(r["hashes"]) + len(r["n"]) for r in counted)
    assert sum(map(len, hashes)) > 5_000 and sent < 9 * sum(map(len, hashes))      # three longs each before


def test_top_of_each_language(spark):
    rows = sample(3)
    assert found(spark, rows, first=3) == brute(rows, first=3)


def test_nulls_long_texts_repeats_and_empty(spark):
    rows = [(None, "en"), ("", "en"), (None, None), ("A b" * 3, None)]
    rows += [("the long word " + "w" * 3000 + " again", "fr")] * 150
    rows += [("one two three four five six " * 400_000, "en")]
    rows += [("same " * 20_000, "de")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(None, None), ("a b c", "en")]) == []


def test_scores_beyond_64_bits_are_exact(spark):
    every = spark.createDataFrame(
        [("en", "x", 10**12, 1), ("en", "y", 10**12, 1), ("en", "x y", 10**12 - 1, 2)], "lang string, phrase string, a long, words int"
    )
    blocks = spark.createDataFrame([("en", 3 * 10**12 + 7)], "lang string, n long")
    from unittest import mock

    with mock.patch.object(phrases, "word_blocks", lambda *_: blocks), mock.patch.object(phrases, "frequent_phrases", lambda *_, **__: every):
        (row,) = phrases.collocations(blocks).collect()
    assert row.score == 1000 * (10**12 - 1) * (3 * 10**12 + 7) // 10**24


@pytest.mark.parametrize("seed", range(4))
def test_trie_walk_equals_a_set(seed):
    draw = random.Random(seed)
    words = [str(i).encode() for i in range(60)]
    texts = {lang: [draw.choice(words) if draw.random() > 0.1 else None for _ in range(4000)] for lang in ("x", "y")}
    depth = draw.randint(1, 4)
    grams = {
        (lang, b" ".join(t[i:i + depth])) for lang, t in texts.items() for i in range(len(t) - depth) if None not in t[i:i + depth] and draw.random() < 0.5
    }
    trie = Trie(list(grams))
    assert len(set(trie.leaf.tolist())) == len(grams)
    for lang, text in [*texts.items(), ("z", texts["x"])]:
        codes = np.array([0 if w is None else words.index(w) + 1 for w in text])
        place, state = trie.walk(lang, trie.symbols(words, codes))
        expected = [i for i in range(len(text) - depth + 1) if None not in text[i:i + depth] and (lang, b" ".join(text[i:i + depth])) in grams]
        assert place.tolist() == expected
        leaf = {s: p for s, p in zip(trie.leaf.tolist(), trie.phrases)}
        assert all(leaf[s] == (lang, b" ".join(text[i:i + depth])) for i, s in zip(place.tolist(), state.tolist()))
    assert len(trie.check) < 12 * (len(grams) * depth + 60)
