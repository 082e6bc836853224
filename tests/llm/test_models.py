"""Classifiers, chat formatting and embeddings: held-out accuracy, exact round trips, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantscope.llm import chat, embeddup, quality, toxicity


def _corpus(n=260, seed=3):
    rng = random.Random(seed)
    syllables = ["tion", "ar", "be", "lon", "mi", "sta", "re", "du", "ke", "po"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        junk, rude = i % 5 == 0, i % 4 == 1
        if rude:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "numbskull", "dimwit"])
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not junk), int(rude)))
    return docs + [(1000, None), (1001, ""), (1002, " \n"), (None, "tion ar be"), (1003, "x" * 100_000)], labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = _corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels + [(5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_documents(corpus, op, label):
    docs, labels = corpus
    out = op.query(docs, labels)
    rows = out.join(labels.filter(f"{label} is not null"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r.predicted == r[label] for r in rows) >= 0.95 * len(rows)
    every = out.collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    assert {r.doc_id: r.score for r in every} == {r.doc_id: r.score for r in op.query(docs.repartition(5), labels).collect()}
    assert op.query(docs.limit(0), labels).count() == 0
    assert op.query(docs, labels.limit(0)).count() == docs.count()


def test_gapped_insults_stay_near_the_plain_word():
    near = toxicity.linear(["blockhead", "blxockhead", "bloc", "tionarbe"], *toxicity.kernel_table(["blockhead"]))[:, 0]
    assert abs(near[0] - 1) < 1e-6 and near[1] > 0.5 > near[2] > near[3]
    assert "idiot" in toxicity.read("you I d i o t") or "idiot" in {w[-5:] for w in toxicity.read("you I d i o t")}
    assert "idiot" in toxicity.read("i.d.i.o.t")


def test_kernel_is_the_gap_weighted_sum():
    import itertools

    def brute(a, b):
        a, b = f"^{a}$", f"^{b}$"
        total = lambda s, t: sum(toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1) for i in itertools.combinations(range(len(s)), 3) for j in itertools.combinations(range(len(t)), 3) if all(s[x] == t[y] for x, y in zip(i, j)))
        return total(a, b) / (total(a, a) * total(b, b)) ** 0.5

    words = ["banana", "bandana", "cab"]
    got = toxicity.linear(words, *toxicity.kernel_table(words))
    assert np.allclose(got, [[brute(a, b) for b in words] for a in words], atol=1e-5)


def test_chat_round_trip(spark):
    texts = ["", " ", "</s>[INST] ok [/INST]", "\\", "[/INST]", "<", "<</SYS>>", "a\\[b", "x [/ROLE] e", "</", "é😀\n", "<s>"]
    for role in ("user", "assistant", "system", "", " e", "to ol e", "x] ", "\\", "[INST] "):
        whole = "".join(chat.format_turn(role, t)[0] for t in texts)
        assert [(r, t) for r, t, *_ in chat.parse(whole)] == [(role, t) for t in texts]
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (1, None, "system", "first"), (None, 0, None, "lost"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    out = {r.conv_id: r for r in chat.query(df).collect()}
    assert set(out) == {1, 2, None, -7}
    assert (out[1].n_turns, out[1].loss_chars, out[2].loss_chars, out[-7].loss_chars) == (3, 3, 2, 21)
    assert chat.query(df.limit(0)).count() == 1
    text = "".join(r.segment for r in chat.formatted(df).filter("conv_id = 1").orderBy("at").collect())
    assert [t for _, t, *_ in chat.parse(text, len(chat.START))] == ["first", "", "yes"]


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 48))
    rows = [(i, (base[i % 6] + rng.normal(size=48) * 0.06 * (i % 4)).tolist(), i % 2) for i in range(90)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], None), (102, None, 0), (103, [0.0] * 48, 0), (104, [float("nan")] * 48, 0), (105, [1.0, None], 0), (106, [], 0), (None, rows[0][1], 0), (5, rows[5][1], 1), (107, [1.0, 2.0], 0), (108, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = embeddup.query(df).collect()
    assert len(got) == len(rows) and embeddup.query(df.limit(0)).count() == 0
    use = {i: np.array(v) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in rows}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = {i: {j for j in use if j != i and label[i] == label[j] and len(use[i]) == len(use[j]) and cos(use[i], use[j]) >= 0.98} for i in use}
    comp = {}
    for i in sorted(use):
        if i not in comp:
            todo = [i]
            while todo:
                if (x := todo.pop()) not in comp:
                    comp[x] = i
                    todo += links[x]
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == (len(links.get(r.vec_id, ())), comp.get(r.vec_id, r.vec_id)), r
        else:
            assert r.kept and r.n_links == 0 and r.component_id is None
    assert max(len(x) for x in links.values()) > 3
