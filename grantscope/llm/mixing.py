"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources, in code-point order with null last, weigh 5, 2, 1, repeating; together they take `share` of all
words; no target exceeds `most` times its source, and the excess is shared out by weight until none does.
Within a source the documents stand in the order of a digest of id and text. A target takes whole passes over its
source and then the first words of one more, so each source's words come to its target, but for the fraction of a word.
A source's weight changes linearly over training time t in [0, 1]; its integral, target * (t + c*(t*t - t)), is
its cumulative demand. Inverting it at a word's offset in the source gives the time that word is due, and the
documents are range-sorted by the time of their first word.

Offsets are running sums over (source, digest) order: the rows are range-partitioned in that order and written, each
partition sums its own rows, and the partitions' totals, one row a partition and source, are added up. A source
that holds most rows is spread over many partitions. Sources are numbered the same way, and targets are filled in rounds
over the table of sources; of it only sums come to the driver.

Defined results: null or wordless text has size 0 and takes nothing. Rows sharing a doc_id are documents of their
own; repeated rows stand side by side, each with its own passes. A null source is a source of its own, after all
others. Rows due at the same time come in the order of doc_id, digest, pass. Extra columns stay; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantscope.llm.common import cut, shield, small

#: Fixed values of the contract: weights, the share of all words to take, and the most of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: How far each weight class leans to later training: its weight at t is 1 + LEAN * (2t - 1) times its mean.
LEAN = (-0.5, 0.25, 0.75)
SIZE_SPLIT = "[\x20\x09-\x0d]++"
#: Tables of a row a source, or a source and partition, are broadcast up to so many rows (some 60 bytes each), else shuffled.
BROADCAST_ROWS = 100_000


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def _dealt(df: DataFrame, label: str, *order) -> DataFrame:
    """`df` written in range partitions of `order`, numbered _p; running sums need no partition but their own then."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), label)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, lean) of each (source, n): water-filling under the caps."""
    in_order = F.col("source").asc_nulls_last()
    dealt = _dealt(sizes, "mix-sources", in_order)
    # a row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("_p").agg(F.count("*").alias("c")).select("_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    number = F.col("first") + F.row_number().over(Window.partitionBy("_p").orderBy(in_order)) - 1
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), (F.col("k") % len(values)).cast("int"))
    plan = dealt.join(F.broadcast(firsts), "_p").withColumn("k", number)
    plan = plan.select("source", F.col("n").alias("source_size"), pick(weights).alias("weight"), pick(LEAN).alias("lean"), (F.col("n") == 0).alias("full"))
    plan = cut(plan, "mix-weights")
    total = plan.agg(F.sum("source_size").alias("n")).first().n or 0
    while True:
        sums = plan.agg(F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open"), F.sum(F.when(F.col("full"), most * F.col("source_size"))).alias("taken")).first()
        if not sums.open:
            return plan.select("source", "source_size", (most * F.col("source_size")).alias("target"), "lean")
        fair = F.lit(share * total - (sums.taken or 0.0)) * F.col("weight") / F.lit(sums.open)
        over = ~F.col("full") & (fair > most * F.col("source_size"))
        if plan.filter(over).isEmpty():
            return plan.select("source", "source_size", F.when(F.col("full"), most * F.col("source_size")).otherwise(fair).alias("target"), "lean")
        plan = cut(plan.withColumn("full", F.col("full") | over), "mix-weights")


def _digest():
    """60 bits of a digest of id and text, the order of a source's documents."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _position(due, lean):
    """When a word is due: t + c*(t*t - t) = due, the root in [0, 1]."""
    root = (F.sqrt((1 - lean) * (1 - lean) + 4 * lean * due) - (1 - lean)) / (2 * lean)
    return F.greatest(F.lit(0.0), F.when(F.abs(lean) < 1e-9, due).otherwise(root))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): its digest _h, copy (0, 1, ... of rows alike in all three), size, source_size,
    target, lean, taken, starts (word offset of each pass in its source's order) and position.

    position is the training time of the document's first word, null where nothing of it is taken.
    """
    words = F.split(F.coalesce("text", F.lit("")), SIZE_SPLIT)
    # blanks at the ends leave an empty word each
    ends = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    size = (F.size(words) - ends).cast("long")
    # one narrow row a document is sorted and summed; the texts stay out of it
    narrow = cut(docs.select("doc_id", "source", size.alias("size"), _digest().alias("_h")), "mix-sizes")
    plan = cut(targets(narrow.groupBy("source").agg(F.sum("size").alias("n")), weights, share, most), "mix-targets")
    distinct = narrow.groupBy("source", "_h", "doc_id", "size").agg(F.count("*").alias("copies"))
    ordered = _dealt(distinct, "mix-order", F.col("source").asc_nulls_last(), "_h", "doc_id", "size")
    sum_of = F.sum(F.col("size") * F.col("copies"))
    totals = ordered.groupBy("_p", "source").agg(sum_of.alias("n"))
    before = Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_p").alias("q"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("_p", "source").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = ordered.withColumn("own", F.coalesce(sum_of.over(inside), F.lit(0)))
    at = at.join(_side(offsets), (F.col("_p") == F.col("q")) & F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = at.join(_side(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = at.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("offset", F.col("before") + F.col("own") + F.col("copy") * F.col("size"))
    rest = F.floor("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset")))
    taken = F.when(F.col("source_size") > 0, passes * F.col("size") + last).otherwise(F.lit(0)).cast("long")
    runs = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    out = (
        at.withColumn("taken", taken)
        .withColumn("starts", F.when(F.col("taken") > 0, F.transform(runs, lambda k: k * F.col("source_size") + F.col("offset"))))
        .withColumn("position", F.when(F.col("taken") > 0, _position(F.col("offset") / F.col("target"), F.col("lean"))))
    )
    return out.select("doc_id", "source", "_h", "copy", "copies", "size", "source_size", "target", "lean", "taken", "starts", "position")


def query(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "source")).orderBy(F.col("position").asc_nulls_last(), "doc_id", "_h", "copy")
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: `docs` in training order, a row for each pass that takes words of a document.

    words is what the pass takes of it (the last pass may end inside a document), position its training time;
    pass, words and position replace columns of these names.
    """
    docs, own = shield(docs.drop("pass", "words", "position"), "doc_id", "text", "source")
    full = mix(docs.select("doc_id", "text", "source")).filter("taken > 0")
    plan = full.select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("_h").alias("m_h"), F.col("copy").alias("m_copy"), "copies", "size", "taken", "target", "lean", F.posexplode("starts").alias("pass", "start")
    )
    plan = plan.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")))
    plan = cut(plan.withColumn("position", _position(F.col("start") / F.col("target"), F.col("lean"))), "mix-passes")
    keyed = docs.withColumn("_h", _digest())
    alike = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("_h") == F.col("m_h")) & F.col("source").eqNullSafe(F.col("m_source"))
    again = plan.filter("copies > 1")
    joined = keyed.join(plan.filter("copies = 1"), alike)
    if not again.isEmpty():
        # repeated rows are numbered, so that each has its own passes
        rows = keyed.join(again.select("m_id", "m_h", "m_source").distinct(), alike, "left_semi")
        other = [F.xxhash64(*docs.columns)]
        rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_h", "source").orderBy(*other)) - 1)
        joined = joined.unionByName(rows.join(again, alike & (F.col("_copy") == F.col("m_copy"))).drop("_copy"))
    return joined.orderBy("position", "doc_id", "_h", "m_copy", "pass").select(*own, "pass", "words", "position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
v AS (SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, CASE k WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.25 ELSE 0.75 END AS lean FROM w),
-- sources by the level at which they are full: the first level that fills no further one holds
f AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / weight, source NULLS LAST) AS r, 2.0 * n / weight AS full_at,
    coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0 * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY 2.0 * n / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, 1.5::DOUBLE * sum(n) OVER () AS whole FROM v),
l AS (SELECT min(r) AS r FROM f WHERE (whole - capped) / open <= full_at),
t AS (SELECT f.source, f.n, f.lean, CASE WHEN l.r IS NULL OR f.r < l.r THEN 2.0::DOUBLE * f.n ELSE (c.whole - c.capped) * f.weight / c.open END AS target
  FROM f CROSS JOIN l LEFT JOIN f c ON c.r = l.r),
o AS (SELECT d.*, t.n, t.lean, t.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) * size + greatest(0, least(size, floor(target) - floor(target / n) * n - off_)) AS BIGINT) ELSE 0 END AS taken FROM o)
SELECT doc_id, size, n AS source_size, target, taken,
  CASE WHEN taken > 0 THEN greatest(0.0::DOUBLE, (sqrt((1 - lean) * (1 - lean) + 4 * lean * (off_ / target)) - (1 - lean)) / (2 * lean)) END AS position
FROM k
"""
