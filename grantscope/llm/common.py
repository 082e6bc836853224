"""What the operators share: tables, durable cuts in the lineage, grouped streams, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantscope.functions.cuts import cut, cuts_of, release, shared_dir  # noqa: F401  (the operators take them from here)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shield(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """`docs` with every column but the `needed` ones renamed out of an operator's way, and the columns that restore it."""
    names = {c: c if c in needed else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def row_key(*columns: str) -> list[Column]:
    """u1, u2: 128 bits that stand for a row's values of `columns`."""
    return [F.xxhash64(*columns).alias("u1"), F.xxhash64(F.lit(11), *columns).alias("u2")]


def small(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows: the check before any broadcast. Reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def join_checked(big: DataFrame, side: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with `side` broadcast when it has at most `rows` rows, else by shuffle with skew handling."""
    return big.join(F.broadcast(side) if small(side, rows) else side, on, how)


def groups(frames, keys: list[str]):
    """Yield (key tuple, frame) for runs of equal keys in sorted pandas batches; a run may span batches."""
    import numpy as np
    import pandas as pd

    held, held_key = [], None
    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.zeros(len(frame), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(frame)]
        for a, b in zip(starts, starts[1:]):
            key = tuple(v[a] for v in values)
            if held and key != held_key:
                yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held, held_key = [*held, frame.iloc[a:b]], key
    if held:
        yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _tied(edges: DataFrame, parts: int = 32) -> DataFrame:
    """(u, v, m) for edges (u, v): m is the least v of u. A node of many edges is dealt over `parts` tasks."""
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(parts)))
    least = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    # at most `parts` rows a node
    least = least.withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return salted.join(least, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, label: str, rounds: int = 40) -> DataFrame:
    """(node, component): smallest node reachable over undirected `edges` (a, b longs), for nodes with an edge.

    Alternates large-star and small-star steps; each ends in a written table, and no group of edges is
    collected: the minimum of a neighbourhood is a partial aggregate, joined back by node and salt.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    for _ in range(rounds):
        # settled: every node has one parent, and no parent has one
        parents = edges.groupBy("u").agg(F.count("*").alias("n"))
        if parents.filter("n > 1").isEmpty() and edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _tied(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: link every smaller neighbour, and the node itself, to the least of them
        tied = _tied(large)
        small_star = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        edges = cut(small_star.filter("u <> v").distinct(), label)
    else:
        raise RuntimeError(f"{label}: components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
