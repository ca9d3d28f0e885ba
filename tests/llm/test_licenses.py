import random
import re

import pytest

from gleanery.llm import licenses

SCHEMA = "doc_id long, text string, key string, words int, label string"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "l") for i, t in rows], SCHEMA)


def found(spark, rows):
    return sorted([tuple(r) for r in licenses.scan(frame(spark, rows)).select(COLUMNS).collect()], key=str)


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label)
        for phrase, label in licenses.BASE
        for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({l for _, l in places}))


def test_base_phrases_equal_brute_force(spark):
    dice = random.Random(3)
    words = "gnu general public license apache cc by mit GNU Mit é ß2 -- , \n".split(" ")
    rows = [(dice.choice([None, *range(20)]), " ".join(dice.choices(words, k=dice.randint(0, 40)))) for _ in range(150)]
    rows += [(None, None), (1, ""), (2, "mit license " * 3000), *rows[:4]]
    expected = sorted([(i, *base_places(t)) for i, t in rows], key=str)
    got = sorted([r[:6] for r in found(spark, rows)], key=str)
    assert got == expected


@pytest.mark.parametrize(("phrase", "label"), licenses.NOTICES)
def test_notices_survive_small_changes(spark, phrase, label):
    words = phrase.split()
    changed = [*words[:3], *words[3:7], "really", *words[7:]]
    rows = [(1, "Intro. " + phrase.upper() + " end"), (2, "x y z " + " ".join(changed)), (3, " ".join(words[: len(words) // 3]))]
    one, two, three = found(spark, rows)
    assert label in one[6].split(",") and one[7] == 1.0 and label in two[6].split(",")
    assert label not in three[6].split(",") and 0 < three[7] <= 1


def test_far_pieces_are_no_alignment(spark):
    words = licenses.NOTICES[0][0].split()
    text = " ".join([*words[:10], *["filler"] * 50, *words[10:18], *["filler"] * 50, *words[18:]])
    assert found(spark, [(1, text)])[0][6] == ""


def test_pairs_with_filler_between_are_no_span(spark):
    words = licenses.NOTICES[4][0].split()
    text = " ".join(f"{a} {b} filler" for a, b in zip(words, words[1:]))
    one = found(spark, [(1, text)])[0]
    assert one[6] == "" and one[7] < 0.5


def best_share(text, phrase):
    """Every chain within the drift, tried one by one; of those that end at a hit the longest, then the latest, counts."""
    words, pattern = text.split(), phrase.split()
    pairs = len(pattern) - 1
    hits = sorted(
        (p, a) for p in range(len(words) - 1) for a in range(pairs) if words[p:p + 2] == pattern[a:a + 2]
    )
    best = 0.0
    for low in {p - a for p, a in hits}:
        band = [(p, a) for p, a in hits if low <= p - a <= low + pairs * (100 - licenses.ACCEPT) // 100]
        for count in range(1, 1 << len(band)):
            chain = [hit for i, hit in enumerate(band) if count >> i & 1]
            if any(x[0] >= y[0] or x[1] >= y[1] for x, y in zip(chain, chain[1:])):
                continue
            longest.setdefault((low, chain[-1]), []).append((len(chain), chain[0][0]))
    for (low, (end, _)), chains in longest.items():
        length, start = max(chains)
        best = max(best, length / max(pairs, end - start + 1))
    longest.clear()
    return best


longest = {}


def test_verified_shares_equal_brute_force(spark):
    dice = random.Random(8)
    notices = (("a b c d e f", "one"), ("a b a b a c", "two"))
    texts = [" ".join(dice.choices("abcdefx", k=dice.randint(0, 14))) for _ in range(120)]
    texts += ["a b c d e f", "a b c x d e f", "a b c x y z d e f", "d e f a b c", "a b a b a c", "c d e f a b", "b c a b c d e f"]
    result = licenses.scan(frame(spark, list(enumerate(texts))), (), notices).collect()
    assert len(result) == len(texts)
    for r in result:
        shares = [best_share(texts[r.doc_id], phrase) for phrase, _ in notices]
        assert r.score == max(shares), texts[r.doc_id]
        assert r.labels == ",".join(label for (_, label), share in zip(notices, shares) if share >= 0.8), texts[r.doc_id]


def test_spans_name_first_and_last_word(spark):
    words = licenses.NOTICES[1][0].split()
    text = " ".join(["x"] * 4 + words[:6] + ["really"] + words[6:] + ["y mit license"])
    got = sorted((r.label, r.first_word, r.last_word) for r in licenses.spans(frame(spark, [(1, text), (2, None)])).collect())
    assert got == [("bsd", 4, 4 + len(words)), ("mit", 6 + len(words), 7 + len(words))]


def test_equal_rows_are_each_returned(spark):
    rows = [(None, "")] * 3 + [(None, None), (1, "mit license"), (1, "mit license"), (1, "other")]
    assert [r[:3] for r in found(spark, rows)] == [(1, 1, 0), (1, 2, 1), (1, 2, 1), (None, 0, 0), (None, 0, 0), (None, 0, 0), (None, 0, 0)]


def test_no_rows_and_no_python(spark):
    scan = licenses.scan(frame(spark, []))
    assert scan.count() == 0
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
