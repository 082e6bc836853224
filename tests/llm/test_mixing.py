"""Source mixing against brute force: targets, words taken, order, repeated rows."""

import hashlib
import random
import re

import pytest

from grantscope.llm import mixing

WEIGHT, LEAN = (5, 2, 1), (-0.5, 0.25, 0.75)


def filled(sizes):
    """Targets by resharing the excess until none is above, in code-point order with None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHT[i % 3] for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, [s for s in order if sizes[s]]
    left = 1.5 * sum(sizes.values())
    while open_:
        fair = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if fair[s] > 2 * sizes[s]]
        if not over:
            target |= fair
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    return target, {s: LEAN[i % 3] for i, s in enumerate(order)}


def brute(rows):
    """(doc_id, size, source_size, target, taken) of each row."""
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target, _ = filled(sizes)
    digest = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    out = []
    for s, n in sizes.items():
        at = 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (digest(r[0], r[1]), r[0] is not None, r[0] or 0)):
            m = words(t)
            whole = int(target[s] // n) if n else 0
            last = max(0, min(m, int(target[s]) - whole * n - at)) if n else 0
            out.append((i, m, n, round(target[s], 6), whole * m + last))
            at += m
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    sources = ["b", "a", "é", "Z", None, "empty", "aa", "small"]
    out = []
    for i in range(160):
        s = rng.choices(sources, [50, 20, 5, 5, 3, 1, 2, 1])[0]
        text = "" if s == "empty" else " ".join(["w"] * rng.randint(0, 30)) + rng.choice(["", " ", "\n", "\x0b"])
        out.append((i, rng.choice([" ", ""]) + text, s))
    # ties, repeated rows, rows sharing an id, nulls
    return out + [out[5], out[5], out[5], (6, "other words", "b"), (None, "no id", "a"), (None, "no id", "a"), (500, None, "a"), (501, "x", "b"), (502, "x", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 3) for r in rows], "doc_id long, text string, source string, position string, taken int").repartition(4)


def test_mixing_matches_brute_force(spark, rows):
    want = brute(rows)
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.query(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for n, t in {(r[2], r[3]) for r in want}:
        assert abs(sum(r[4] for r in want if (r[2], r[3]) == (n, t)) - t * sum(1 for x in {(r[2], r[3]) for r in want} if x == (n, t))) < 1
    again = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.query(frame(spark, rows[::-1])).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_the_mix_takes_what_the_plan_says(spark, rows):
    want = brute(rows)
    out = mixing.mixed(frame(spark, rows)).collect()
    assert out[0].__fields__ == ["doc_id", "text", "source", "taken", "pass", "words", "position"]
    assert sum(r.words for r in out) == sum(r[4] for r in want)
    taken, given = {}, {}
    for r in out:
        taken[(r.doc_id, r.text)] = taken.get((r.doc_id, r.text), 0) + r.words
    texts = sorted(((i, t, s) for i, t, s in rows), key=str)
    for (i, m, *_, k), (j, t, _) in zip(sorted(want, key=lambda r: str(r[0])), sorted(texts, key=lambda r: str(r[0]))):
        assert i == j
        given[i] = given.get(i, 0) + k
    assert {i: n for i, n in given.items() if n} == {i: sum(v for (j, _), v in taken.items() if j == i) for i in {j for j, _ in taken}}
    assert [r.position for r in out] == sorted(r.position for r in out) and 0 <= out[0].position and out[-1].position <= 1
    order = [(r.position, r.doc_id is not None, r.doc_id or 0) for r in out]
    assert order == sorted(order)


def test_targets(spark):
    def of(*sizes):
        found = mixing.targets(spark.createDataFrame(list(sizes), "source string, n long")).orderBy(mixing.F.col("source").asc_nulls_last()).collect()
        return [(r.source, round(r.target, 6)) for r in found]

    assert of((None, 10), ("b", 100), ("a", 10), ("Z", 0)) == [("Z", 0), ("a", 20), ("b", 140), (None, 20)]
    many = [(f"s{i:03}", (i * 37) % 90) for i in range(400)]
    assert of(*many) == [(s, round(t, 6)) for s, t in filled(dict(many))[0].items()]
    assert of(("a", 0)) == [("a", 0)] and of() == []


def test_empty_table(spark, rows):
    none = frame(spark, rows).limit(0)
    assert mixing.query(none).count() == 0 and mixing.mixed(none).count() == 0
