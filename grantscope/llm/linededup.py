"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of descending doc_id ranges. A batch's line keys (128-bit hash, documents holding it,
largest doc_id holding it) are merge-anti-joined with the runs so far: a key that no run has is the batch's own and
names its keeper, the largest doc_id; for a key that some run has the batch only adds its count. Own keys and counts
are added as a new run. Runs are tables bucketed and sorted by hash, so that joins with them and merges of
them move none of their rows; runs of one level are compacted into the next when `fan_in` of them stand there. The last
merge knows every key's count and its one keeper; of a key of `min_docs` documents every other occurrence is dropped.

Defined results: null or empty text is one empty line. Rows sharing a doc_id count as one document for
the threshold. A null doc_id belongs to no document: its lines raise no count and fall to any frequent
key. Repeated rows get the same result each. Extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantscope.llm.common import ascii_lower, cut, cuts_of, sha256_hex, shield
from grantscope.llm.spans import let

#: Fixed values of the contract: what is stripped from a line's ends; the least code points; the least documents.
STRIPPED, MIN_CHARS, MIN_DOCS = " \t\n\x0b\x0c\r", 20, 3
KEY = ["h1", "h2"]


class LineRuns:
    """The levelled index. add() takes batches in descending order of doc_id; merged() merges what is left."""

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in, self.levels, self.tables = spark, fan_in, {}, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels.values() for run in level]

    def add(self, lines: DataFrame) -> None:
        keys = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        for run in self.runs():
            # the anti-join, as a mark: a key that the run has keeps its count and loses its claim
            keys = keys.join(run.select(*KEY, F.lit(True).alias("had")), KEY, "left")
            keys = keys.select(*KEY, "n", F.when(F.col("had").isNull(), F.col("keeper")).alias("keeper"))
        self._keep(0, keys)

    def merged(self) -> DataFrame:
        """One row per key: documents holding it in all batches, and its keeper."""
        out, *rest = self.runs()
        for run in rest:
            out = _merge(out, run)
        return out

    def drop(self) -> None:
        """Forget the runs' tables; their files go with the cuts."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _keep(self, level: int, run: DataFrame) -> None:
        own = self.levels.setdefault(level, [])
        own.append(self._written(run, level))
        if len(own) == self.fan_in:
            self.levels[level] = []
            out, *rest = own
            for other in rest:
                out = _merge(out, other)
            self._keep(level + 1, out)

    def _written(self, run: DataFrame, level: int) -> DataFrame:
        # as many buckets as a shuffle has partitions, so that a batch's keys meet them without another shuffle
        buckets, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"line_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").option("path", f"{cuts_of(self.spark)}/line-run-{level}-{name}").option("compression", "zstd")
        writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)


def _merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs as one: counts add up, and a key's keeper stands in one of them only."""
    o = other.select(*KEY, F.col("n").alias("m"), F.col("keeper").alias("k"))
    n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
    return one.join(o, KEY, "full").select(*KEY, n.alias("n"), F.coalesce("keeper", "k").alias("keeper"))


def index_lines(docs: DataFrame, min_chars: int, batches: int) -> tuple[DataFrame, LineRuns]:
    """(lines, index): the key of every line of `docs` (doc_id, text) that is long enough, and the index of them."""
    key = ascii_lower(F.btrim("line", F.lit(STRIPPED)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("b")).first().b if batches > 1 else None
    bounds = sorted(set(bounds or []))
    # batch 0 holds the largest ids; null ids belong to none
    batch = F.when(F.col("doc_id").isNull(), -1).otherwise(sum(((F.col("doc_id") <= b).cast("int") for b in bounds), F.lit(0)))
    # the text's hash and the batch are worked out once a document, below the generator
    split = F.split(F.coalesce("text", F.lit("")), "\n").alias("held")
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("th"), batch.alias("batch"), split)
        .select("doc_id", "th", "batch", F.posexplode_outer("held").alias("pos", "line"))
        .withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "batch")
    )
    lines = cut(lines, "lines", "batch")
    index = LineRuns(docs.sparkSession)
    for k in range(len(bounds) + 1):
        index.add(lines.filter(F.col("batch") == k))
    return lines, index


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """`docs` (doc_id, text, ...) with kept_text, n_lines and n_dropped beside its own columns, which they replace."""
    docs, own = shield(docs.drop("kept_text", "n_lines", "n_dropped"), "doc_id", "text")
    lines, index = index_lines(docs, min_chars, batches)
    # written plainly: a shuffled side lets a key that many documents share be split over tasks
    frequent = cut(index.merged().filter(F.col("n") >= min_docs).select(*KEY, "keeper"), "frequent-lines")
    index.drop()
    drops = (
        lines.join(frequent, KEY)
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("drops"))
        .select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"), "drops")
    )
    joined = docs.withColumn("_th", F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("_th") == F.col("d_th")), "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), "drops")
    kept = let(F.col("_lines"), lambda held: F.array_join(F.transform(stay, lambda i: F.get(held, i)), "\n"))
    return (
        joined.withColumn("_lines", split)
        .withColumn("n_lines", F.size("_lines"))
        .withColumn("kept_text", F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
        .select(*own, "kept_text", F.col("n_lines").cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("drops"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"))
    )


def query(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
often AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, (o.k IS NOT NULL AND l.doc_id <> o.keeper) AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
