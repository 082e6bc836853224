"""Embedding near-dedup by cross-polytope hashing.

1. A unit vector is turned by fast Hadamard rotations (three rounds of random signs and a Walsh-Hadamard
   transform); its hash is the signed axis it lies nearest to. Several hashes make a table's bucket: as many as a
   label's rows ask for, so that a bucket holds few vectors by chance however large the table is. Each table also
   probes the buckets with some hash replaced by its runner-up, those of least loss first, more of them the more
   hashes there are.
2. Equal vectors of a label are one class, counted with its size. Buckets hold ids. A bucket's classes, with their
   vectors in eight bits a component, are read as a stream against its leaders: a class ties itself to every leader
   within CORE and the link angle, and stops at one within CORE. By the triangle inequality of angles, two linked
   classes end in one cluster, from O(m) edges. A bucket over HOT classes is dealt over tasks by a hash of the
   class, and every two parts' leaders are tied if they lie within twice CORE and the link angle.
3. Connected components of those edges are clusters. Their vectors meet in blocks, a large cluster dealt over
   block pairs; cosines are matrix products in double precision. Links are counted, not listed: out come each
   class's links and a spanning forest.

What remains of chance is whether two linked vectors share a bucket. Measured on 4,000 random pairs of 64 dimensions at
a cosine of 0.98 exactly, a table holds a pair with probability 0.86 for two hashes, 0.72 for three and 0.74 for four;
ten tables miss it with probability 2e-9, 3e-6 and 1e-6.

Defined results: null vectors, zero vectors, vectors with null or non-finite components and vectors of a null label
link with nothing; vectors of different lengths never link. Labels are compared as text, whatever their type (numbers
equal as numbers are equal as text). Rows sharing vec_id and vector count once; of rows sharing only vec_id, the one
of the least digest speaks for all. A null vec_id is kept, unlinked, component_id null. Extra columns don't matter.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from grantscope.llm.common import components, cut, groups, small

TABLES, MOST_HASHES, BLOCK = 10, 8, 256
#: Classes of a bucket that one task reads; for very large buckets, PART times the square root of its size.
HOT, PART = 2048, 32
#: Fixed value of the contract: cosine from which vectors of a label are linked.
COSINE = 0.98
#: Angles of step 2, in degrees; SLACK is what eight bits a component may be off.
CORE_DEGREES, SLACK_DEGREES = 25.0, 1.0
#: Ids of clustered classes that may be broadcast to find their vectors (16 bytes each); more are shuffled.
BROADCAST_ROWS = 200_000


@cache
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng(99 + size).choice([-1.0, 1.0], (TABLES * MOST_HASHES, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def hashes_for(rows: int, d: int) -> int:
    """Hashes a table needs for a label of so many vectors: four buckets or more to a vector."""
    return int(min(MOST_HASHES, max(2, np.ceil(np.log(max(4 * rows, 2)) / np.log(2 * _width(d))))))


def buckets(unit: np.ndarray, hashes: int) -> np.ndarray:
    """vectors x (TABLES * probes) bucket numbers; `hashes` of them make one, and hashes - 1 (at least two) are probed."""
    m, d = unit.shape
    size, probes = _width(d), max(2, hashes - 1)
    wide = np.zeros((m, size))
    wide[:, :d] = unit
    best, second, loss = [], [], []
    for signs in _signs(size)[: TABLES * hashes]:
        x = wide
        for s in signs:
            x = hadamard(x * s)
        order = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
        pair = np.take_along_axis(x, order, 1)
        swap = np.abs(pair[:, 0]) < np.abs(pair[:, 1])
        order[swap], pair[swap] = order[swap][:, ::-1], pair[swap][:, ::-1]
        code = order * 2 + (pair < 0)
        best.append(code[:, 0])
        second.append(code[:, 1])
        loss.append((np.abs(pair[:, 0]) - np.abs(pair[:, 1])) ** 2)
    best, second, loss = (np.stack(x, axis=1).reshape(m, TABLES, hashes) for x in (best, second, loss))
    # probes: subsets of hashes replaced by runners-up, in order of the loss; the first replaces none
    flips = np.array([[(f >> h) & 1 for h in range(hashes)] for f in range(2**hashes)])
    order = np.argsort((loss[:, :, None, :] * flips).sum(axis=3), axis=2, kind="stable")[:, :, :probes]
    number = np.zeros(order.shape, np.uint64) + np.arange(TABLES, dtype=np.uint64)[None, :, None]
    with np.errstate(over="ignore"):
        for h in range(hashes):
            code = np.where(flips[order][..., h] == 1, second[:, :, None, h], best[:, :, None, h]).astype(np.uint64)
            number = (number + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            number ^= number >> np.uint64(29)
    return number.reshape(m, -1).view(np.int64)


def _unit(vectors, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(positions of those that are finite and not zero, their unit vectors), for vectors of one length."""
    x = np.array([v for v in vectors], np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1)
        fine = np.flatnonzero(np.isfinite(x).all(axis=1) & (top > 0))
        x = x[fine] / top[fine, None]
    return fine, x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _hashed(hashes: dict[int, int]):
    def run(frames):
        for f in frames:
            out = []
            usable = np.array([len(v) > 0 and not any(x is None for x in v) for v in f["embedding"]], bool)
            length = np.array([len(v) for v in f["embedding"]])
            for size in np.unique(length[usable]):
                at = np.flatnonzero(usable & (length == size))
                fine, x = _unit(f["embedding"].iloc[at])
                if not len(fine):
                    continue
                rows = f.iloc[at[fine]]
                eight = np.round(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
                # wider vectors than the widest counted have its number of hashes
                own = buckets(x, hashes.get(int(size), MOST_HASHES))
                out.append(pd.DataFrame({"vec_id": rows["vec_id"].to_numpy(), "s1": rows["s1"].to_numpy(), "s2": rows["s2"].to_numpy(), "label": rows["label"].to_numpy(), "d": np.int32(size), "eight": [v.tobytes() for v in eight], "buckets": list(own)}))
            if out:
                yield pd.concat(out)

    return run


HASHED = "vec_id long, s1 long, s2 long, label string, d int, eight binary, buckets array<long>"


def _floats(column: pd.Series, d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.int8).reshape(-1, d).astype(np.float32)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


class Leaders:
    """The leaders of one part of a bucket, as its members stream by. Leaders tied together by members count as one."""

    def __init__(self, d: int):
        self.ids, self.marks, self.trees = [], np.empty((16, d), np.float32), np.empty(0, np.int64)

    def join(self, node: int, mark: np.ndarray, loose: float, core: float) -> list[int]:
        """The leaders that `node` is tied to, one a tree; with none of them within `core` it leads too."""
        near = self.marks[: len(self.ids)] @ mark
        sure = np.flatnonzero(near >= core)
        last = sure[0] + 1 if len(sure) else len(near)
        tied = np.flatnonzero(near[:last] >= loose)
        trees, first = np.unique(self.trees[tied], return_index=True)
        if len(trees) > 1:
            self.trees[np.isin(self.trees, trees)] = trees[0]
        if not len(sure):
            if len(self.ids) == len(self.marks):
                self.marks = np.concatenate([self.marks, np.empty_like(self.marks)])
            self.marks[len(self.ids)] = mark
            self.trees = np.append(self.trees, trees[0] if len(trees) else len(self.ids))
            self.ids.append(node)
            return [node, *(self.ids[tied[i]] for i in first)]
        return [self.ids[tied[i]] for i in first]


def _angles(link: float) -> tuple[float, float, float]:
    """Cosines: within core, within core and a link, within twice core and a link; all with slack for eight bits."""
    core, slack, linked = np.radians(CORE_DEGREES), np.radians(SLACK_DEGREES), np.arccos(link)
    return np.cos(core), np.cos(core + linked + 2 * slack), np.cos(2 * core + linked + 4 * slack)


def _lead(link: float):
    core, loose, _ = _angles(link)

    def run(frames):
        at, leaders = None, None
        for f in frames:
            out = []
            d = f["d"].to_numpy()
            for size in np.unique(d) if len(f) else ():
                # keys differ between lengths, so a bucket's rows are of one
                own = f[d == size]
                for key, part, node, mark in zip(own["key"].to_numpy(), own["part"].to_numpy(), own["id"].to_numpy(), _floats(own["eight"], size)):
                    if at != (key, part):
                        at, leaders = (key, part), Leaders(size)
                    out += [(key, part, node, b) for b in leaders.join(node, mark, loose, core)]
            yield pd.DataFrame(out, columns=["key", "part", "a", "b"]).astype({"key": "int64", "part": "int32", "a": "int64", "b": "int64"})

    return run


def _lead_pairs(link: float):
    far = _angles(link)[2]

    def run(frames):
        for (_, i, j), f in groups(frames, ["key", "i", "j"]):
            x, ids, part = _floats(f["eight"], f["d"].iloc[0]), f["id"].to_numpy(), f["part"].to_numpy()
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            out = []
            for a in left:
                near = right[x[right] @ x[a] >= far]
                out += [(ids[a], ids[b]) for b in near]
            yield pd.DataFrame(_forest(out), columns=["a", "b"], dtype="int64")

    return run


def _forest(pairs: list[tuple]) -> list[tuple]:
    """The pairs that join two trees."""
    home = {}

    def root(x):
        home.setdefault(x, x)
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    out = []
    for a, b in pairs:
        one, other = root(a), root(b)
        if one != other:
            home[one] = other
            out.append((a, b))
    return out


def _count(link: float):
    """Per block pair: (a, b, links): a row (id, id, n) adds n links to a class, a row with b <> a is a forest edge."""

    def run(frames):
        for (_, i, j), f in groups(frames, ["cluster", "i", "j"]):
            ids, many, block = f["id"].to_numpy(), f["many"].to_numpy(), f["block"].to_numpy()
            label, d = f["label"].to_numpy(), np.array([len(v) for v in f["embedding"]])
            out = []
            for size in np.unique(d):
                for name in np.unique(label[d == size]):
                    at = np.flatnonzero((d == size) & (label == name))
                    _, x = _unit(f["embedding"].iloc[at])
                    out += _links(ids[at], many[at], block[at], x, i, j, link)
            yield pd.DataFrame(out, columns=["a", "b", "links"], dtype="int64")

    return run


def _links(ids, many, block, x, i: int, j: int, link: float) -> list[tuple]:
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    linked = x[left] @ x[right].T >= link
    if i == j:
        np.fill_diagonal(linked, False)
    total = dict(zip(ids[left], linked @ many[right]))
    if i != j:
        total |= dict(zip(ids[right], linked.T @ many[left]))
    out = [(a, a, n) for a, n in total.items() if n]
    # forest: grow each tree breadth-first over the matrix
    whole = np.zeros((len(ids), len(ids)), bool)
    whole[np.ix_(left, right)] = linked
    whole |= whole.T
    fresh = np.ones(len(ids), bool)
    for start in range(len(ids)):
        if not fresh[start]:
            continue
        fresh[start], todo = False, [start]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(whole[at] & fresh)
            fresh[found] = False
            todo += found.tolist()
            out += [(ids[y], ids[at], 0) for y in found]
    return out


def _label(vectors: DataFrame) -> Column:
    if isinstance(vectors.schema["label"].dataType, (DoubleType, FloatType)):
        return (F.col("label") + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    return F.col("label").cast("string")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    usable = vectors.filter("label is not null and embedding is not null and vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), _label(vectors).alias("label"), "embedding",
        F.xxhash64(_label(vectors), "embedding").alias("s1"), F.xxhash64(F.lit(5), _label(vectors), "embedding").alias("s2"),
    )
    # rows of the largest label, by length: one row a length comes to the driver, of the 64 commonest lengths
    sizes = usable.groupBy("label", F.size("embedding").alias("d")).agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n"))
    hashes = {r.d: hashes_for(r.n, r.d) for r in sizes.orderBy(F.desc("n"), "d").limit(64).collect() if r.d > 0}
    hashed = usable.mapInPandas(_hashed(hashes), HASHED)
    one = F.struct("s1", "s2", "label", "d", "eight", "buckets")
    hashed = cut(hashed.groupBy("vec_id").agg(F.min_by(one, F.struct("s1", "s2")).alias("x")).select("vec_id", "x.*"), "vectors")
    # two digests of label and vector, 128 bits, stand for it among equal ones
    classes = hashed.groupBy("s1", "s2").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"))
    member = cut(hashed.select("vec_id", "s1", "s2").join(classes, ["s1", "s2"]).select("vec_id", "id", "many"), "vector-classes")
    heads = member.filter("vec_id = id").select("id", "many")
    own = hashed.join(heads, F.col("vec_id") == F.col("id"))
    entries = own.select("id", F.explode(F.array_distinct("buckets")).alias("b"), "label", "d").select("id", F.xxhash64("label", "d", "b").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.greatest(F.lit(HOT), F.ceil(PART * F.sqrt("n")))).cast("int")
    placed = cut(entries.join(shared, "key").select("key", "id", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")), "vector-buckets")
    marks = own.select("id", "d", "eight")
    read = placed.join(marks, "id").repartition("key", "part").sortWithinPartitions("key", "part", "id").select("key", "part", "id", "d", "eight")
    ties = cut(read.mapInPandas(_lead(cosine), "key long, part int, a long, b long"), "vector-ties")
    edges = ties.filter("a <> b").select("a", "b").distinct()
    hot = placed.filter("parts > 1").select("key", "parts").distinct()
    if not hot.isEmpty():
        leaders = ties.filter("a = b").join(hot, "key").select("key", "part", "parts", F.col("a").alias("id")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        leaders = leaders.filter("o <> part").select("key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "id").join(marks, "id")
        pairs = leaders.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").select("key", "i", "j", "part", "id", "d", "eight")
        edges = edges.unionByName(pairs.mapInPandas(_lead_pairs(cosine), "a long, b long"))
    clusters = components(edges, "vector-clusters").withColumnRenamed("component", "cluster")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chosen = clusters.join(blocks, "cluster").join(heads, F.col("node") == F.col("id")).join(hashed.select("vec_id", "s1", "s2"), F.col("vec_id") == F.col("id"))
    chosen = cut(chosen.select("id", "many", "cluster", "blocks", F.col("s1").alias("c1"), F.col("s2").alias("c2")), "vector-chosen")
    side = F.broadcast(chosen) if small(chosen, BROADCAST_ROWS) else chosen
    found = usable.join(side, (F.col("vec_id") == F.col("id")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    # repeated rows come once
    found = found.groupBy("id").agg(*[F.first(c).alias(c) for c in ("many", "cluster", "blocks", "label", "embedding")])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = found.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "many", "label", "embedding")
    counted = cut(pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").mapInPandas(_count(cosine), "a long, b long, links long"), "vector-links")
    links = counted.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    grouped = components(counted.filter("a <> b").select("a", "b"), "vector-groups").select(F.col("node").alias("id"), "component")
    named = member.join(links, "id", "left").join(grouped, "id", "left").select(F.col("vec_id").alias("m_id"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    joined = vectors.select("vec_id").join(named, F.col("vec_id") == F.col("m_id"), "left")
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors.select("vec_id", "embedding", "label"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
n AS (SELECT x, count(DISTINCT y) AS n_links FROM l GROUP BY x),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, CAST(least(e.vec_id, coalesce(c.low, e.vec_id)) AS BIGINT) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""
