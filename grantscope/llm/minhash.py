"""Near-dedup by b-bit MinHash.

1. Sketch every document: its distinct word shingles as 64-bit hashes, the minima under `PERMS` hash
   functions, band keys over the first `BANDS * ROWS` full minima, and the low `BITS` bits of all minima
   packed into a signature. Equal sets (by a 128-bit digest) form a class; its smallest doc_id stands for it.
2. Bands give buckets of classes. A bucket is read as a stream against its leaders: similarity is estimated
   from the signatures by bit counts, corrected for chance collisions. A class ties itself to the first leader
   it seems linked to, or leads. A bucket over HOT classes is dealt over tasks by a hash of the class, and the
   leaders of its parts are read against one another the same way.
3. Ties are confirmed on the full sets, each leader's set beside a part of its members' sets. Components of the
   confirmed ties are the groups found so far: of a group of near copies nearly all of it.
4. What is left are pairs of a bucket from different groups. Buckets of one group alone are done. The others'
   signatures meet in block pairs, so no task holds a large bucket; a pair counts in the first bucket it shares.
   Only classes with a likely pair (an estimate of MAYBE) bring their full sets to their block pair, where a
   spanning forest of confirmed links between groups comes out. No pair is listed.
5. Components of those links over the groups name each document's group by its smallest doc_id.

What remains of chance: two linked documents share none of 20 bands with probability 3e-5 at a similarity of 0.80
(4e-7 at 0.85); an estimate of 128 minima falls under MAYBE at 0.80 with probability 3e-7 (standard error 0.035).

Defined results: null or wordless text has an empty set and links with nothing; fewer than `words` words make
one shingle, the whole sequence. Rows sharing a doc_id are one node of the graph, linked by any of their texts. A row
with a null doc_id gets component_id null and is kept. Repeated rows get the same result each; extra columns stay.
"""

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantscope.llm.common import LOWER, UPPER, components, cut, groups, shield, small

PERMS, BANDS, ROWS, BITS = 128, 20, 4, 4
#: Estimates from which a class ties itself to a leader, and from which a pair is worth an exact look.
TIE, MAYBE = 0.74, 0.62
#: Classes of a bucket that one task reads, members whose sets one task confirms, classes of a block.
HOT, STAR, BLOCK = 256, 256, 512
#: Parts of a bucket, or of a set's copies, that are counted apart.
SALTS = 16
SPLIT = re.compile("[^\x20\x09-\x0d]+")
_AZ = str.maketrans(UPPER, LOWER)
_MIX = np.uint64(0x9E3779B97F4A7C15)
MAX_CACHED_WORDS = 400_000


@cache
def _hashers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 2**32, PERMS, dtype=np.uint32), rng.integers(0, 2**32, PERMS, dtype=np.uint32) | np.uint32(1)


class Words(dict):
    """word -> 64-bit hash, computed once while it fits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, words: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    found = SPLIT.findall(text.translate(_AZ)) if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minima(own: np.ndarray) -> np.ndarray:
    seeds, odd = _hashers()
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 1024):
        out = np.minimum(out, ((low[None, a : a + 1024] ^ seeds[:, None]) * odd[:, None]).min(axis=1))
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum; the multiplier above mixes high bits better, so those are folded in."""
    low = ((least ^ (least >> np.uint32(15)) ^ (least >> np.uint32(23))) & np.uint32(2**BITS - 1)).astype(np.uint64)
    return (low.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


_ONES = np.uint64(sum(1 << i for i in range(0, 64, BITS)))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature with many, by bit counts."""
    x = many ^ one
    for step in (1, 2)[: BITS // 2]:
        x = x | (x >> np.uint64(step))
    equal = PERMS - np.bitwise_count(x & _ONES).sum(axis=-1)
    chance = 2.0**-BITS
    return (equal / PERMS - chance) / (1 - chance)


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    mixed = own * _MIX
    return int(np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29))).view(np.int64)), int(own.sum(dtype=np.uint64).view(np.int64))


SKETCH = "n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>"


def _sketch(words: int):
    @F.pandas_udf(SKETCH)
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words()
        for texts in batches:
            rows = []
            for text in texts:
                own = shingles(text, words, known)
                if len(own):
                    least = minima(own)
                    bands = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]
                    rows.append((len(own), *_digest(own), np.array(bands, np.uint64).view(np.int64), pack(least).view(np.int64)))
                else:
                    rows.append((0, 0, 0, np.empty(0, np.int64), np.empty(0, np.int64)))
            yield pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "bands", "sig"])

    return sketched


def _packed(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).view(np.uint64)


def _lead(frames):
    """Ties (key, a, b, near) of classes a to leaders b of their bucket's part; a leader itself has b = a. Holds the leaders only."""
    bucket, ids, sigs, n = None, [], None, 0
    for f in frames:
        out = []
        for key, part, node, sig in zip(f["key"].to_numpy(), f["part"].to_numpy(), f["id"].to_numpy(), _packed(f["sig"]) if len(f) else ()):
            if bucket != (key, part):
                bucket, ids, sigs, n = (key, part), [], np.empty((16, len(sig)), np.uint64), 0
            near = estimate(sig, sigs[:n])
            sure = np.flatnonzero(near >= TIE)
            if len(sure):
                out.append((key, node, ids[sure[0]], near[sure[0]]))
                continue
            if n == len(sigs):
                sigs = np.concatenate([sigs, np.empty_like(sigs)])
            sigs[n], n = sig, n + 1
            ids.append(node)
            out.append((key, node, node, 1.0))
        yield pd.DataFrame(out, columns=["key", "a", "b", "near"]).astype({"key": "int64", "a": "int64", "b": "int64", "near": "float64"})


TIES = "key long, a long, b long, near double"


def _sets(words: int):
    def run(frames):
        known = Words()
        for f in frames:
            found = [shingles(t, words, known) for t in f["text"]]
            digest = np.array([_digest(x) for x in found], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": f["id"], "s1": digest[:, 0], "s2": digest[:, 1], "set": [x.view(np.int64) for x in found]})

    return run


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(one, other, assume_unique=True).size
    return 100 * both >= percent * (len(one) + len(other) - both)


def _confirm_ties(percent: int):
    """The ties (a, b) that hold on full sets; rows come by leader and part, the leader's own sets first."""

    def run(frames):
        at, held = None, []
        for f in frames:
            out = []
            for leader, part, node, own in zip(f["b"], f["part"], f["id"], f["set"]):
                if at != (leader, part):
                    at, held = (leader, part), []
                if node == leader:
                    if not any(np.array_equal(own, h) for h in held):
                        held.append(own.copy())
                elif any(_linked(own, h, percent) for h in held):
                    out.append((node, leader))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _likely(f: pd.DataFrame, i: int, j: int, key: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x, y) of the likely pairs between groups in a block pair, likeliest first."""
    sig, bands, group, size, block = _packed(f["sig"]), np.stack(f["bands"].to_numpy()), f["grp"].to_numpy(), f["n_shingles"].to_numpy(), f["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    # a block may have no class in this bucket
    xs, ys, likes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for a in range(0, len(left), 64):
        x = left[a : a + 64]
        near = estimate(sig[x][:, None, :], sig[right][None, :, :])
        fits = (near >= MAYBE) & (group[x][:, None] != group[right][None, :])
        fits &= 100 * np.minimum(size[x][:, None], size[right]) >= percent * np.maximum(size[x][:, None], size[right])
        if i == j:
            fits &= x[:, None] < right[None, :]
        p, q = np.nonzero(fits)
        xs.append(x[p])
        ys.append(right[q])
        likes.append(near[p, q])
    x, y, near = np.concatenate(xs), np.concatenate(ys), np.concatenate(likes)
    if len(x):
        first = np.argmax(bands[x] == bands[y], axis=1)
        here = bands[x, first] == key
        x, y, near = x[here], y[here], near[here]
    order = np.argsort(-near, kind="stable")
    return x[order], y[order]


def _take_part(percent: int):
    """Per block pair of a bucket: the classes with a likely pair."""

    def run(frames):
        for (key, i, j), f in groups(frames, ["key", "i", "j"]):
            x, y = _likely(f, i, j, key, percent)
            if len(x):
                yield f.iloc[np.union1d(x, y)][["key", "i", "j", "block", "id", "s1", "s2", "grp", "n_shingles", "sig", "bands"]]

    return run


def _confirm_pairs(percent: int):
    """Per block pair: a forest (a, b) of the links between groups that hold on full sets."""

    def run(frames):
        for (key, i, j), f in groups(frames, ["key", "i", "j"]):
            group, sets = f["grp"].to_numpy(), f["set"].to_numpy()
            home = {g: g for g in group}

            def root(g):
                while home[g] != g:
                    home[g] = home[home[g]]
                    g = home[g]
                return g

            out = []
            for x, y in zip(*_likely(f, i, j, key, percent)):
                one, other = root(group[x]), root(group[y])
                if one != other and _linked(sets[x], sets[y], percent):
                    home[one] = other
                    out.append((group[x], group[y]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


PART = "key long, i int, j int, block int, id long, s1 long, s2 long, grp long, n_shingles long, sig array<long>, bands array<long>"


def _ties(own: DataFrame, bucketed: DataFrame, broadcast_rows: int) -> DataFrame:
    """(a, b): at most two ties of a class a, to its first leader and its nearest (step 2)."""
    side = lambda df: F.broadcast(df) if small(df, broadcast_rows) else df
    part = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.ceil(F.col("n") / HOT)).cast("int").alias("part")
    read = lambda rows: rows.repartition("key", "part").sortWithinPartitions("key", "part", "id").select("key", "part", "id", "sig").mapInPandas(_lead, TIES)
    signed = bucketed.join(own.select("id", "sig"), "id")
    first = cut(read(signed.select("key", "id", "sig", part(0))), "ties")
    # leaders of the parts of hot buckets
    hot = bucketed.filter(F.col("n") > HOT).select("key").distinct()
    leaders = first.filter("a = b").join(side(hot), "key").select("key", F.col("a").alias("id"))
    counts = cut(leaders.groupBy("key").agg(F.count("*").alias("n")), "leader-counts")
    ties = first
    if not counts.isEmpty():
        second = leaders.join(side(counts), "key").join(own.select("id", "sig"), "id")
        ties = ties.unionByName(read(second.select("key", "id", "sig", part(1))))
    found = ties.filter("a <> b").groupBy("a").agg(F.min("b").alias("b1"), F.max_by("b", F.struct("near", -F.col("b"))).alias("b2"))
    return cut(found.select("a", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("b")), "chosen-ties")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) per row of `docs`, and (m_id, component_id) per doc_id with words. Links: Jaccard >= percent / 100.

    `broadcast_rows` bounds the tables of doc_ids and of hot buckets that may be broadcast; larger ones are shuffled.
    """
    sketch = cut(docs.select("doc_id", _sketch(words)("text").alias("k")).select("doc_id", "k.*"), "sketch")
    filled = sketch.filter("n_shingles > 0 and doc_id is not null")
    recurs = not filled.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    # copies are joined by their set's digest and a salt, so that a set of many copies is no single task's
    copies = filled.select("doc_id", "s1", "s2", "n_shingles", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    same = ["s1", "s2", "n_shingles"]
    least = copies.groupBy(*same, "salt").agg(F.min("doc_id").alias("id")).withColumn("id", F.min("id").over(Window.partitionBy(*same)))
    member = cut(copies.join(least, [*same, "salt"]).select("doc_id", "id").distinct(), "members")
    own = filled.join(member.filter("doc_id = id").select("id"), F.col("doc_id") == F.col("id")).select("id", "s1", "s2", "n_shingles", "sig", "bands")
    own = own.dropDuplicates(["id", "s1", "s2"]) if recurs else own
    banded = own.select("id", F.explode("bands").alias("key")).distinct()
    # buckets are counted and joined by key and salt, so that a large one is no single task's
    banded = banded.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SALTS)))
    counts = banded.groupBy("key", "salt").agg(F.count("*").alias("c"))
    shared = counts.withColumn("n", F.sum("c").over(Window.partitionBy("key"))).filter("n > 1").drop("c")
    bucketed = cut(banded.join(shared, ["key", "salt"]), "buckets")
    ids = cut(bucketed.select("id").distinct(), "bucketed")
    side = F.broadcast(ids) if small(ids, broadcast_rows) else ids
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("id")).select("id", "text")
    sets = texts.mapInPandas(_sets(words), "id long, s1 long, s2 long, set array<long>")
    sets = cut(sets.dropDuplicates(["id", "s1", "s2"]) if recurs else sets, "sets")
    # step 3: a leader's sets go to each part of its members
    ties = _ties(own, bucketed, broadcast_rows)
    sizes = ties.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = ties.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("id"))
    wanted = dealt.unionByName(dealt.select("b", "part", F.col("b").alias("id")).distinct())
    stars = wanted.join(sets.select("id", "set"), "id").withColumn("second", F.col("id") != F.col("b"))
    stars = stars.repartition("b", "part").sortWithinPartitions("b", "part", "second", "id").select("b", "part", "id", "set")
    confirmed = stars.mapInPandas(_confirm_ties(percent), "a long, b long")
    if recurs:
        # the classes of one doc_id's texts are one node
        low = member.groupBy("doc_id").agg(F.min("id").alias("b"))
        confirmed = confirmed.unionByName(member.join(low, "doc_id").filter("id <> b").select(F.col("id").alias("a"), "b"))
    grouped = cut(components(confirmed, "stars"), "groups").withColumnRenamed("component", "grp")
    # step 4: buckets that still hold several groups
    named = bucketed.join(grouped.withColumnRenamed("node", "id"), "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    ends = named.groupBy("key", "salt").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    by_key = Window.partitionBy("key")
    mixed = ends.withColumn("mixed", F.min("low").over(by_key) < F.max("high").over(by_key)).filter("mixed").select("key", "salt")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = named.join(mixed, ["key", "salt"]).join(own, "id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block b of a bucket meets every block: pair (i, j), i <= j, where b is i or j
    open_ = open_.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "s1", "s2", "grp", "n_shingles", "sig", "bands")
    in_pairs = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    likely = cut(in_pairs(open_).mapInPandas(_take_part(percent), PART), "likely")
    links = in_pairs(likely.join(sets, ["id", "s1", "s2"])).mapInPandas(_confirm_pairs(percent), "a long, b long")
    # step 5: the links join groups, not documents
    joined = components(links, "group-links").select(F.col("node").alias("grp"), "component")
    every = member.join(grouped.withColumnRenamed("node", "id"), "id", "left").withColumn("grp", F.coalesce("grp", "id")).join(joined, "grp", "left")
    result = every.select(F.col("doc_id").alias("m_id"), F.coalesce("component", "grp").alias("component_id"))
    result = result.groupBy("m_id").agg(F.min("component_id").alias("component_id")) if recurs else result
    return sketch.select("doc_id", "n_shingles"), result


def mark_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with component_id and kept, which replace columns of these names."""
    safe, own = shield(docs.drop("component_id", "kept"), "doc_id", "text")
    _, named = near_duplicates(safe, words, percent)
    joined = safe.join(named, F.col("doc_id") == F.col("m_id"), "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select(*own, "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    counted, named = near_duplicates(docs, words=2)
    joined = counted.join(named, F.col("doc_id") == F.col("m_id"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
