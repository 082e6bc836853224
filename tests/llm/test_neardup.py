"""Near-dedup of texts and vectors against brute force, with buckets small enough to be dealt over tasks."""

import random
import re

import numpy as np
import pytest

from grantscope.llm import common, embeddup, minhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_of(ids, links):
    """Smallest id reachable, by flooding."""
    low = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = i
                todo += links[x]
    return low


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ))
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randint(0, 30))
    common_part = [word() for _ in range(40)]
    docs, n = {}, 0
    for g in range(14):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            # up to a twelfth of the words change: similarities on both sides of the threshold
            for k in rng.sample(range(len(own)), len(own) * rng.randint(0, 5) // 60):
                own[k] = word()
            docs[n] = " ".join(own)
            n += 1
    for _ in range(20):
        # unlike texts around one long common part
        docs[n] = " ".join(common_part + [word() for _ in range(rng.randint(2, 40))])
        n += 1
    for i in range(5):
        docs[n + i] = docs[i].upper() + " \n"
    return docs


@pytest.mark.parametrize("words, hot", [(2, 4), (5, 2048)])
def test_groups_match_brute_force(spark, monkeypatch, texts, words, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "BLOCK", max(2, hot // 2))
    monkeypatch.setattr(minhash, "STAR", max(2, hot // 2))
    sets = {i: shingles(t, words) for i, t in texts.items()}
    links = {i: [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}
    want = groups_of(sets, links)
    assert 10 < len(set(want.values())) < len(want) - 10, len(set(want.values()))
    rows = [(i, t) for i, t in texts.items()]
    # repeated rows, and extra columns of clashing names
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + rows[:3]], "doc_id long, text string, key string, grp int, n int").repartition(3)
    found = minhash.mark_near_duplicates(df, words=words).select("doc_id", "component_id", "kept").collect()
    assert len(found) == len(rows) + 3
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) for r in found)


def test_texts_of_one_id_are_one_node(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, one), (2, one + " x"), (2, other), (3, other + " y"), (4, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.query(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3000, 2999), (5, 5)]
    rng.shuffle(edges)
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    want = groups_of(links, links)
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


@pytest.mark.parametrize("label", ["int", "string", "double"])
def test_vectors_match_brute_force(spark, monkeypatch, label):
    monkeypatch.setattr(embeddup, "HOT", 4)
    monkeypatch.setattr(embeddup, "PART", 1)
    monkeypatch.setattr(embeddup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 32))
    names = {"int": [0, 1], "string": ["a", "b"], "double": [1.2, 1.7]}[label]
    rows = []
    for i in range(120):
        v = base[i % 5] + rng.normal(size=32) * (0.12 if i % 3 else 0.19) * (i % 4 > 0)
        rows.append((i, [float(np.float32(x)) for x in v * (1 + i % 3)], names[i % 2]))
    rows += [(200, rows[0][1], names[0]), (200, rows[0][1], names[0])]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    of = {i: x for i, _, x in rows}
    links = {i: [j for j in unit if j != i and of[i] == of[j] and unit[i] @ unit[j] >= 0.98] for i in unit}
    want = groups_of(unit, links)
    got = embeddup.query(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {label}").repartition(4)).collect()
    assert len(got) == len(rows) and 5 < len(set(want.values())) < 110
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), want[r.vec_id], r.vec_id == want[r.vec_id]), r


def test_hashes_grow_with_a_label_and_keep_recall():
    assert [embeddup.hashes_for(n, 64) for n in (10, 4_000, 5_000, 500_000, 10**9)] == [2, 2, 3, 3, 5]
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    for hashes in (2, 3, 4, 5):
        one, other = embeddup.buckets(a, hashes), embeddup.buckets(near, hashes)
        met = np.array([np.intersect1d(x, y).size > 0 for x, y in zip(one, other)])
        assert met.mean() >= 0.999, hashes
        assert np.mean([np.intersect1d(x, y).size > 0 for x, y in zip(one, one[::-1])]) < 0.05
