"""Word vectors of the quality classifier: long texts, surrogates, contexts."""

import random

import numpy as np

from grantscope.llm import quality


def test_a_long_text_pools_like_its_words_at_once():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeéß漢", k=rng.randint(1, 9))) for _ in range(20_000)]
    text = " ".join(words)
    vectors = quality.Vectors()
    own = vectors.of(words).astype(np.float64)
    mean = own.mean(axis=0)
    want = [*mean, *np.sqrt((own**2).mean(axis=0) - mean**2), np.einsum("ij,ij->i", own[1:], own[:-1]).mean()]
    around = vectors.pooled(["x y", text, None, "", " \n", "x y"])
    assert np.abs(around[1][: len(want)] - want).max() < 1e-4
    assert (around[0] == around[5]).all() and not around[2:5].any()
    assert (vectors.pooled([text])[0] == around[1]).all()


def test_index_vectors_are_of_the_word_alone():
    words = ["a", "ab", "\ud800x", "a" * 5000, "ab"]
    together = quality.index_vectors(words)
    alone = np.concatenate([quality.index_vectors([w]) for w in words])
    assert np.allclose(together, alone, atol=1e-6) and np.allclose((together**2).sum(axis=1), 1, atol=1e-5)


def test_contexts_match_brute_force():
    import pandas as pd

    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (1, 2, 50, 20_000, 3)]
    frames = [pd.DataFrame({"text": texts[:3]}), pd.DataFrame({"text": [*texts[3:], None]})]
    counted = pd.concat(quality._counts(frames)).groupby("word")["n"].sum().to_dict()
    # one word has no vector of its own and counts as a neighbour all the same
    parts = pd.concat(quality._contexts({w: i for i, w in enumerate("abcdefg")})(frames))
    got = {w: g["near"].sum() for w, g in parts.groupby("word")}
    one = quality.Vectors()
    want = {}
    for t in texts:
        w = t.split()
        v = one.of(w)
        for i, x in enumerate(w):
            n, s = want.get(x, (0, 0))
            want[x] = (n + 1, s + (v[i - 1] if i else 0) + (v[i + 1] if i + 1 < len(w) else 0))
    assert counted == {w: n for w, (n, _) in want.items()} and set(got) == set("abcdefg")
    assert all(np.allclose(got[w], want[w][1], atol=0.5) for w in got)


def test_temperature_may_sharpen():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, quality.POOLED)) + 0.6 * y[:, None]
    model = quality.train(x, y, {}, np.zeros((0, quality.DIM), np.float32), epochs=2)
    assert model.temperature < 1


def test_recurring_documents_are_learned_from_once(spark):
    docs = [(i % 40, "good words here" if i % 40 % 2 else "BAD!! BAD!!") for i in range(400)]
    labels = [(i, i % 2) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y")
    out = quality.query(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == 400 and len({(r.doc_id, r.score) for r in out}) == 40
