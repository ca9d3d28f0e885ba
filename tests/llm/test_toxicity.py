import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from gleanery.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, _score double, toxic string"
BAD = ["horrible", "wretched", "vermin"]


@pytest.fixture(scope="module")
def corpus(spark):
    dice = random.Random(1)
    words = [f"{a}{b}" for a in "the ran sol mer tin por".split() for b in "ing er a ous ly".split()]
    rows = []
    for i in range(600):
        text = dice.choices(words, k=dice.randint(20, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text[dice.randrange(len(text))] = dice.choice(BAD)
        rows.append((i, " ".join(text), "x", 0.5, "t", int(toxic)))
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return rows, docs, labels


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.train(corpus[1], corpus[2])


def test_held_out_rows_are_told_apart(corpus, model):
    held = [r for r in corpus[0] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((model.score(r[1]) >= toxicity.THRESHOLD) == bool(r[5]) for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)


def subwords(text):
    """Every word and n-gram of 3 to 5 characters by plain loops, one entry for each time a word occurs."""
    out = []
    for word in toxicity.WORD.findall((text or "").lower()):
        marked, grams = "<" + word + ">", set()
        for start in range(len(marked)):
            for end in range(start + 3, min(start + 5, len(marked)) + 1):
                grams.add(marked[start:end])
        out += [xxhash.xxh32_intdigest(g) % toxicity.BUCKETS for g in sorted(grams | {marked})]
    return out


def test_scores_equal_the_softmax_of_the_plain_average(corpus, model):
    for text in [r[1] for r in corpus[0][:40]] + ["", None, "?!", "a", "Horrible HORRIBLE é\u4f60\u597d_x9"]:
        found = subwords(text)
        average = sum((model.vectors[b].astype(float) for b in found), np.zeros(toxicity.WIDTH)) / max(1, len(found))
        logits = [float(model.weights[c] @ average + model.bias[c]) for c in (0, 1)]
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(logits[0] - logits[1])), abs=1e-6)


def test_a_step_of_the_fit_follows_the_gradient(monkeypatch):
    """One step from one seed, against gradients of the log loss by finite differences."""
    texts, labels = ["sol vermin", "sol tin", "ran the sol", "vermin vermin"], [1, 0, 0, 1]
    monkeypatch.setattr(toxicity, "RATE", 0.0)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    bags = [toxicity.bag(t) for t in texts]
    start = toxicity.fit(bags, labels)
    monkeypatch.setattr(toxicity, "RATE", 1e-3)
    after = toxicity.fit(bags, labels)

    def loss(bias, weights, vectors):
        total = 0.0
        for text, label in zip(texts, labels):
            average = vectors[subwords(text)].mean(axis=0)
            logits = weights @ average + bias
            total += math.log(sum(math.exp(x) for x in logits)) - logits[label]
        return total / len(texts)

    def slope(which, at):
        parts = [start.bias.copy(), start.weights.copy(), start.vectors.astype(float)]
        sides = []
        for sign in (1, -1):
            moved = [p.copy() for p in parts]
            moved[which][at] += sign * 1e-4
            sides.append(loss(*moved))
        return (sides[0] - sides[1]) / 2e-4

    for c in (0, 1):     # Adagrad's first step has length RATE against the sign of the gradient
        assert after.bias[c] - start.bias[c] == pytest.approx(-1e-3 * np.sign(slope(0, c)), rel=1e-2)
        for w in range(0, toxicity.WIDTH, 5):
            g = slope(1, (c, w))
            assert after.weights[c, w] - start.weights[c, w] == pytest.approx(-1e-3 * g / math.sqrt(g * g + 1e-8), rel=0.05, abs=2e-5)
    bucket = subwords("vermin")[0]
    step = after.vectors[bucket].astype(float) - start.vectors[bucket]
    slopes = np.array([slope(2, (bucket, w)) for w in range(toxicity.WIDTH)])
    expected = -4e-3 * slopes / math.sqrt((slopes**2).mean() + 1e-8)
    assert step == pytest.approx(expected, rel=0.05, abs=5e-5)


def test_misspellings_share_subwords(model):
    plain = "soling merer tina porous thea ranly " * 5
    assert model.score(plain + "horribles wretchedd verminn " * 3) > 0.5 > model.score(plain)


def test_labels_of_held_out_rows_are_not_used(corpus, model):
    rows, docs, labels = corpus
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = toxicity.train(docs, other)
    assert (again.vectors == model.vectors).all() and (again.weights == model.weights).all()


def test_scores_of_odd_texts_and_filter(spark, corpus, model, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    docs = spark.createDataFrame(
        [(1, None, "x", 0.5, "t"), (None, "", "x", 0.5, "t"), (2, "vermin " * 20_000, "x", 0.5, "t"), (3, "w" * 100_000, "x", 0.5, "t"), (3, "? !", "x", 0.5, "t")],
        SCHEMA,
    )
    scores = [r._score for r in toxicity.scored(docs.drop("_score"), corpus[2]).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == scores[4]
    kept = toxicity.without_toxic(docs, corpus[2])
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"]
    assert toxicity.without_toxic(docs.where("false"), corpus[2]).count() == 0


@pytest.mark.parametrize(("marks", "score"), [([], 1e-6), ([0, 0], 1e-6), ([1, 1], 1 - 1e-6)])
def test_without_both_labels_scores_are_constant(marks, score):
    model = toxicity.fit([([1, 2], [1, 1])] * len(marks), marks)
    assert model.score("anything") == model.score(None) == pytest.approx(score, rel=1e-3)


def test_no_labels_at_all(spark, corpus):
    model = toxicity.train(corpus[1], corpus[2].where("false"))
    assert model.score("text") < 0.01


@pytest.mark.parametrize("filler", ["soltinmer" * 20, "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 20, "sol_tin_7_" * 20])
def test_words_without_spaces_are_scored_to_their_end(model, filler):
    plain = model.score(filler)
    assert model.score(filler + "vermin" * 40) > plain + 0.2     # all of it after the first 64 characters
    assert model.score(filler + "vermin" + filler) > plain


def test_slices_hold_every_ngram_of_a_long_word():
    dice = random.Random(3)
    for size in [65, 66, 118, 119, 120, 121, 122, 123, 124, 300]:
        word = "".join(map(chr, dice.sample(range(0x4E00, 0x9000), size)))     # all n-grams differ
        marked = f"<{word}>"
        grams = [marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]
        found = [f for part in toxicity.long_word_features(word) for f in part]
        assert sorted(found) == sorted(toxicity._buckets([g])[0] for g in grams)


def test_long_words_count_in_the_fit():
    features, counts = toxicity.bag("w" * 200 + "vermin")
    assert set(toxicity._buckets({"vermi", "min>"})) <= set(features)


def test_rare_words_of_a_long_row_count_in_the_fit():
    text = " ".join(f"w{i} w{i}" for i in range(5000)) + " vermin"
    features, counts = toxicity.bag(text)
    assert set(toxicity.word_features("vermin")) <= set(features) and len(features) == len(counts) <= toxicity.BUCKETS
