"""The levelled runs of the line dedup: one owner a key, merges without shuffles, very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from grantscope.llm import linededup


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    line = lambda: f"a line of text, number {rng.randint(0, 60)} of them"
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 8)))) for i in range(200)] + [(None, line()), (7, line())]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_one_run_owns_a_key(docs, batches):
    lines, index = linededup.index_lines(docs, linededup.MIN_CHARS, batches)
    assert len(index.runs()) == bin(batches).count("1")
    every = {}
    for run in index.runs():
        for r in run.collect():
            every.setdefault((r.h1, r.h2), []).append(r)
    want = {(r.h1, r.h2): (r.n, r.k) for r in lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("k")).collect()}
    # without the anti-join a key would have as many owners as batches that hold it, and a wrong keeper after a merge
    assert all(sum(r.keeper is not None for r in rows) == 1 for rows in every.values())
    assert {k: (sum(r.n for r in rows), max(r.keeper for r in rows if r.keeper is not None)) for k, rows in every.items()} == want
    assert {(r.h1, r.h2): (r.n, r.keeper) for r in index.merged().collect()} == want
    index.drop()


def test_merges_move_no_rows(spark, docs):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, index = linededup.index_lines(docs, linededup.MIN_CHARS, 3)
        plan = index.merged()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        index.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_very_long_texts(spark):
    shared = "\n".join(f"a line that stands in many texts, {i}" for i in range(20_000))
    rows = [(1, shared), (2, shared), (3, shared + "\n" + "x" * 1_000_000), (4, "\n" * 100_000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (20_000, 20_000), 2: (20_000, 20_000), 3: (20_001, 0), 4: (100_001, 0)}
