"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

1. Postings: every token of the documents that is a benchmark term, as (term, document, position), in parts that stand
   in document order, so that a document's 128-bit key costs a part next to nothing. A document's end is one more
   posting, whose position is its word count. A term's list is read by a join on the term.
2. Each benchmark window (`window` words, or the whole of a shorter item) is looked up by its rarest term in
   the corpus. A posting of that term at an item's offset gives a candidate alignment (document, item, shift).
3. The lists of the other terms, adjusted by their offsets, are intersected with the candidates: the expected
   postings of an alignment are semi-joined with the index. Runs of `window` matches are exact phrases;
   windows with at least `near` of their words in place are proximity matches (query and drop: NEAR of ten).

Defined results: null or wordless documents have no words and no hits; null or wordless items match nothing.
Rows sharing doc_id and text share their hits; rows sharing only doc_id are told apart by their text. A null
item_id is listed as an empty string; rows sharing an item_id are one item. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantscope.llm.common import ascii_lower, cut, row_key, sha256_hex, shield, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
#: Stands for a document's end among its terms: what splitting leaves after the last word.
END = ""
#: Fixed value: words of a ten-word window that must be in place for a proximity match.
NEAR = 8
#: Sides with at most so many rows may be broadcast (some 40 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: A document's key.
DOC = ["u1", "u2"]


def words_of(text):
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def postings(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The index (tid, u1, u2, doc_id, pos), one row per token of `docs` that is among `tokens`, and each document's end."""
    terms = tokens.select("word").union(docs.sparkSession.createDataFrame([(END,)], "word string")).distinct()
    terms = cut(terms.withColumn("tid", F.xxhash64("word")), "terms")
    # keys are worked out once a document, below the generator; a blank at the end makes the end a word of its own, so
    # that no list is empty (the outer form, or Spark would split every text once more to leave empty lists out)
    text = F.regexp_replace(F.concat(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(" ")), f"^{BETWEEN}", "")
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), F.split(text, BETWEEN, -1).alias("words"))
    found = keyed.select("doc_id", *DOC, F.posexplode_outer("words").alias("pos", "word"))
    return cut(found.join(_side(terms), "word").select("tid", *DOC, "doc_id", "pos"), "postings")


def _windows(tokens: DataFrame, often: DataFrame, window: int, probes: int) -> DataFrame:
    """The `probes` rarest terms of every window that occur in the corpus: (iid, j, w, rarest)."""
    by_item = Window.partitionBy("iid")
    terms = F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "j", "tid")).over(by_item.orderBy("j").rowsBetween(0, window - 1))
    ranked = tokens.join(often, "tid", "left").withColumn("n", F.count("*").over(by_item)).withColumn("terms", F.array_sort(terms))
    ranked = ranked.withColumn("w", F.least(F.lit(window), "n")).filter("j <= n - w")
    chosen = F.slice("terms", F.lit(1), F.when(F.col("w") < window, 1).otherwise(probes))
    return ranked.withColumn("rarest", F.explode(chosen)).filter("rarest.df > 0")


def matches(docs: DataFrame, items: DataFrame, window: int = 10, near: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, phrases, proximity): phrases are (u1, u2, item, start, end) runs; proximity counts near items by document.

    An exact window is found by its rarest term. One with `near` of its words in place holds at least two of its
    window - near + 2 rarest there, so these are all looked up when proximity is asked for, and only alignments
    with two of them go on. A window shorter than `window` counts when exact alone, and needs its rarest term.
    """
    need = 1 if near is None or near < 2 else 2
    probes = 1 if near is None else window - near + need
    near = near or window
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.xxhash64("item_id", "text").alias("iid"), words_of(F.col("text")).alias("words"))
    tokens = named.select("item", "iid", F.posexplode("words").alias("j", "word"))
    tokens = cut(tokens.distinct().withColumn("tid", F.xxhash64("word")), "item-tokens")
    index = postings(docs, tokens)
    often = index.groupBy("tid").agg(F.count("*").alias("df"))
    ranked = _windows(tokens, often, window, probes)
    anchors = ranked.groupBy("iid", F.col("rarest.tid").alias("tid"), F.col("rarest.j").alias("a")).agg(
        F.min("j").alias("lo"), F.max(F.col("j") + F.col("w") - 1).alias("hi"), F.min(F.when(F.col("w") < window, 1).otherwise(need)).alias("need")
    )
    anchors = cut(anchors, "anchors")
    found = index.join(_side(anchors), "tid").select(*DOC, "iid", (F.col("pos") - F.col("a")).alias("shift"), "lo", "hi", "need")
    aligned = found.groupBy(*DOC, "iid", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.min("need").alias("need"))
    expected = aligned.filter("n >= need").select(*DOC, "iid", "shift", F.explode(F.sequence("lo", "hi")).alias("j"))
    lists = tokens.select("iid", "j", "tid", "item")
    expected = expected.join(_side(lists), ["iid", "j"]).withColumn("pos", F.col("shift") + F.col("j"))
    expected = cut(expected.filter("pos >= 0"), "expected")
    held = index.join(_side(expected.select(*DOC).distinct()), DOC, "left_semi").select(*DOC, "pos", "tid")
    hit = expected.join(held, [*DOC, "pos", "tid"], "left_semi")
    line = Window.partitionBy(*DOC, "iid", "shift").orderBy("j")
    sizes = tokens.groupBy("iid").agg(F.least(F.lit(window), F.count("*")).alias("w"))
    ordered = hit.join(_side(sizes), "iid").withColumn("run", F.col("j") - F.row_number().over(line)).withColumn("ahead", F.lead("j", near - 1).over(line))
    ordered = cut(ordered, "aligned")
    phrases = ordered.groupBy(*DOC, "iid", "item", "shift", "run", "w").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    phrases = phrases.filter("end - start + 1 >= w").select(*DOC, "item", "start", "end")
    close = ordered.filter((F.col("w") == window) & (F.col("ahead") - F.col("j") < window))
    return index, phrases, close.groupBy(*DOC).agg(F.count_distinct("item").alias("n_near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, near: int | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, u1, u2, n_words, n_hit, items (sorted array), contaminated, n_near (items near it, exact ones too)."""
    index, phrases, proximity = matches(docs, items, window, near)
    phrases = cut(phrases, "phrases")
    covered = phrases.select(*DOC, F.explode(F.sequence("start", "end")).alias("p")).distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    named = phrases.groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = index.filter(F.col("tid") == F.xxhash64(F.lit(END))).select(*DOC, "doc_id", F.col("pos").cast("long").alias("n_words"))
    hits = covered.join(named, DOC).join(proximity, DOC, "full")
    return ends.join(hits, DOC, "left").select(
        "doc_id", *DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs, items, near=NEAR)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated", "n_near")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, near: int | None = NEAR) -> DataFrame:
    """`docs` without the rows that hold a benchmark window, or `near` words of one in their places."""
    safe, own = shield(docs, "doc_id", "text")
    hit = contamination(safe, items, window, near).filter("contaminated or n_near > 0").select(*DOC).distinct()
    keyed = safe.select("*", *row_key("doc_id", "text"))
    return keyed.join(_side(cut(hit, "hit-documents")), DOC, "left_anti").select(*own)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[s : s + l - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.s, dw.l, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d), bp AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM b WHERE len(w) >= 10),
al AS (SELECT doc_id, item_id, p - j AS shift, list(j) AS js FROM dp JOIN bp ON dp.x = bp.x GROUP BY doc_id, item_id, p - j HAVING count(*) >= 8),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM al WHERE len(list_filter(js, lambda a: len(list_filter(js, lambda c: c >= a AND c < a + 10)) >= 8)) > 0 GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ks, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated, CAST(coalesce(nr.n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id LEFT JOIN nr ON d.doc_id = nr.doc_id
"""
