"""Corpus operators do the whole job."""

import random

from grantscope.llm import decontaminate


def test_proximity_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, [rng.choice(words) for _ in range(n)]) for i, n in enumerate((10, 11, 14, 30, 9, 3))]
    docs = []
    for i in range(60):
        own = list(rng.choice(items)[1])
        for k in rng.sample(range(len(own)), min(len(own), i % 5)):
            own[k] = f"other{k}"
        # some start or end inside the passage
        docs.append((i, [rng.choice(words) for _ in range(i % 3)] + own[i % 4 if i % 7 == 0 else 0 :] + [rng.choice(words) for _ in range(i % 2)]))
    near, exact = {}, {}
    for i, d in docs:
        at = lambda p, d=d: d[p] if 0 <= p < len(d) else None
        best = lambda b, w: max((sum(at(s + k) == b[j + k] for k in range(w)) for j in range(len(b) - w + 1) for s in range(-w, len(d))), default=0)  # noqa: B023, E731
        near[i] = sum(len(b) >= 10 and best(b, 10) >= 8 for _, b in items)
        exact[i] = any(best(b, min(10, len(b))) == min(10, len(b)) for _, b in items)
    assert any(near[i] and not exact[i] for i in near) and any(not near[i] and not exact[i] for i in near)
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.query(table, bench).collect()}
    assert {i: r.n_near for i, r in found.items()} == near and {i: r.contaminated for i, r in found.items()} == exact
    assert {r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()} == {i for i in near if not near[i] and not exact[i]}
