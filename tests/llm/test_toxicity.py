"""Inserted letters, alphabets and recurring rows of the toxicity scorer."""

import random

import numpy as np

from grantscope.llm import toxicity

INSULTS = ["blockhead", "numbskull", "dimwitted", "жалкийнеуч", "réeuxment"]


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    syllables = ["tion", "ar", "be", "lon", "mi", "sta", "re", "du", "ke", "po", "éa", "ñu", "да", "ни", "ку"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(15, 50))]
        rude = i % 4 == 1
        if rude:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        docs.append((i, " ".join(words)))
        labels.append((i, int(rude)))
    return docs, labels


def test_inserted_letters_and_gaps_are_tolerated():
    docs, labels = corpus()
    model = toxicity.train([toxicity.read(t) for _, t in docs], np.array([x for _, x in labels]))
    fresh, truth = corpus(n=200, seed=9)
    rng = random.Random(1)
    plain = [t for (_, t), (_, x) in zip(fresh, truth) if not x]
    scorer = toxicity.Scorer(model)
    assert (scorer.scores(plain) >= toxicity.THRESHOLD).mean() <= 0.01
    for change in (
        lambda w: w, lambda w: w[:4] + rng.choice("abcxyz") + w[4:], lambda w: " ".join(w), lambda w: ".".join(w), lambda w: w[:3] + w[2] + w[3:], lambda w: "!" + w.upper() + "?",
    ):
        texts = [t + " " + change(rng.choice(INSULTS)) for t in plain]
        assert (scorer.scores(texts) >= toxicity.THRESHOLD).mean() >= 0.9


def test_letters_of_other_alphabets_differ():
    table, rows = toxicity.kernel_table(["неуч"])
    alike = toxicity.linear(["неуч", "жало", "neuc"], table, rows)[:, 0]
    assert abs(alike[0] - 1) < 1e-6 and alike[1] < 0.2 and alike[2] < 0.2


def test_recurring_documents_are_learned_from_once(spark):
    docs, labels = corpus(n=80)
    out = toxicity.query(spark.createDataFrame(docs * 5, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == 400 and len({(r.doc_id, r.score) for r in out}) == 80


def test_landmarks_are_spread_by_their_kernel():
    words = ["banana", "bananas", "cabin", "dozen"]
    assert toxicity._spread(words, np.array([5.0, 4.9, 3.0, 2.0]), 3) == ["banana", "cabin", "dozen"]
    assert toxicity._spread([], np.array([]), 3) == []
