"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame functions only.

One pass over the texts finds the base spans (email, ip, card, phone) and the identifier-like strings: tokens with a
digit or an at sign and the digit groups that follow, and addresses with a spelled-out (at). Strings that overlap a
base span are seeds of its kind. A string's lexical patterns are the word before it, the two words before it, the
word after it, and a label that it carries itself ("tel:0451..."). The bootstrap then works on the graph of
patterns and strings:

1. A pattern is induced by a kind if `support` different seeds of the kind stand in it.
2. All occurrences of the induced patterns in the corpus are counted, with or without a string in them. A pattern
   whose share of occurrences with a string of the kind is under `density` says nothing of the kind and goes: a
   common word stands before some identifier by chance, a telling one mostly does.
3. For `rounds` rounds a pattern is as sure of a kind as its strings are on average, smoothed; a string is as sure as
   its patterns together make it (noisy or). Strings that became sure are seeds of the next round, so patterns that
   no base span ever stood in are induced too.
4. Patterns that end above `sure` mark the unseen strings in them that have the kind's form.

Defined results: null text is empty text. Rows sharing doc_id and text get equal results. A null doc_id is a
document like any other. Texts without matches have no spans; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantscope.llm.common import ascii_lower, cut, row_key, sha256_hex, small
from grantscope.llm.spans import as_spans, digits, joined, let, lower_bound, matched, passes_luhn

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that they take linear time: possessive, and tried where a run starts.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_VALID = rf"^{IP_PART}(?:\.{IP_PART}){{3}}\z"
#: Identifier-like strings: an address with a spelled-out at sign, or a token with a digit or at sign and the digit groups after it.
SPELLED = r"[A-Za-z0-9._%+-]++\x20?[\[({](?i:at)[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?i:dot)[\])}]\x20?)[A-Za-z0-9-]++)*+"
TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[0-9()][0-9().-]*+)*+"
IDENTIFIER = rf"(?:(?<=[\x20\x09-\x0D])|^)(?:{SPELLED}|{TOKEN})"
#: A label that a token carries itself, and what ends a sentence or a quotation after it.
LABEL = r"^[^\x20\x09-\x0D0-9@+(]{0,40}[:=]"
TAIL = ".,;:!?\"')]}|"
#: Patterns are few: only those `support` seeds induce. A broadcast holds at most so many.
BROADCAST_PATTERNS = 50_000


def base_spans(text: Column) -> dict[str, Column]:
    digit = F.regexp_like(text, F.lit("[0-9]"))
    number = lambda m: digits(m["text"])
    ip = F.filter(matched(text, IP, F.contains(text, F.lit(".")) & digit), lambda m: F.regexp_like(m["text"], F.lit(IP_VALID)))
    card = F.filter(matched(text, CARD, digit), lambda m: F.char_length(number(m)).between(13, 19))
    return {
        "email": matched(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": ip,
        "card": F.filter(card, lambda m: passes_luhn(number(m))),
        "phone": F.filter(matched(text, PHONE, F.contains(text, F.lit("+")) & digit), lambda m: F.char_length(number(m)).between(9, 15)),
    }


def _spaced(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def _last_words(before: Column, n: int) -> Column:
    """The last `n` words; what a longer stretch holds before its last 400 characters is no part of them."""
    return F.trim(F.substring_index(F.rtrim(_spaced(F.right(before, F.lit(400)))), " ", -n))


def _candidate(m: Column) -> Column:
    """One identifier-like match as struct<value, start, end, patterns>."""
    label = F.regexp_extract(m["text"], LABEL, 0)

    def shaped(x: Column) -> Column:
        start = m["start"] + F.char_length(x["label"])
        one, two = ascii_lower(_last_words(m["before"], 1)), ascii_lower(_last_words(m["before"], 2))
        after = ascii_lower(F.substring_index(F.ltrim(_spaced(F.left(m["after"], F.lit(400)))), " ", 1))
        after = F.when(x["value"] == F.substring(m["text"], F.char_length(x["label"]) + 1, F.char_length(m["text"])), after).otherwise("")
        named = F.when(x["label"] != "", F.array(F.concat(F.lit("0 "), ascii_lower(x["label"])))).otherwise(
            F.filter(
                F.array(
                    F.when(one != "", F.concat(F.lit("1 "), one)), F.when(F.contains(two, F.lit(" ")), F.concat(F.lit("2 "), two)),
                    F.when(after != "", F.concat(F.lit("3 "), after)),
                ),
                lambda p: p.isNotNull(),
            )
        )
        return F.struct(x["value"].alias("value"), start.alias("start"), (start + F.char_length(x["value"])).alias("end"), named.alias("patterns"))

    rest = F.rtrim(F.substring(m["text"], F.char_length(label) + 1, F.char_length(m["text"])), F.lit(TAIL))
    return let(F.struct(label.alias("label"), rest.alias("value")), shaped)


def _read(docs: DataFrame) -> DataFrame:
    """(u1, u2, doc_id, base, candidates): all that the rest needs of the texts; u1, u2 identify a row's id and text."""
    text = F.coalesce("text", F.lit(""))
    some = F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit(r"[0-9]|[\[({](?i:at)[\])}]"))

    def seeded(found: dict[str, Column], candidates: Column) -> Column:
        # a candidate is a seed of the first kind that has a span which ends after its start and starts before its end
        def kind_of(c: Column, kinds: list[tuple[str, Column]]) -> Column:
            out = F.lit(None).cast("string")
            for kind, spans in reversed(kinds):
                first = F.get(spans["start"], lower_bound(spans["end"], c["start"] + 1))
                out = F.when((F.size(spans["end"]) > 0) & F.coalesce(first < c["end"], F.lit(False)), kind).otherwise(out)
            return out

        each = lambda c, kinds: F.struct(c["value"].alias("value"), c["start"].alias("start"), c["end"].alias("end"), c["patterns"].alias("patterns"), kind_of(c, kinds).alias("seed"))
        sides = F.struct(*[F.struct(F.transform(m, lambda s: s["start"]).alias("start"), F.transform(m, lambda s: s["end"]).alias("end")).alias(k) for k, m in found.items()])
        kinds = lambda s: [(k, s[k]) for k in found]
        return let(sides, lambda s: F.transform(candidates, lambda c: each(c, kinds(s))))

    def row(f: Column) -> Column:
        found = {k: f[k] for k in KINDS}
        base = F.concat(*[as_spans(m, i, k) for i, (k, m) in enumerate(found.items())])
        candidates = F.filter(F.transform(matched(text, IDENTIFIER, some), _candidate), lambda c: c["value"] != "")
        return F.struct(base.alias("base"), F.when(some, seeded(found, candidates)).alias("candidates"))

    spans = F.struct(*[c.alias(k) for k, c in base_spans(text).items()])
    read = docs.select(*row_key("doc_id", "text"), "doc_id", let(spans, row).alias("r"))
    return cut(read.select("u1", "u2", "doc_id", "r.base", "r.candidates"), "pii")


def _form(kind: Column, value: Column) -> Column:
    n = F.char_length(digits(value))
    return (
        F.when(kind == "email", F.regexp_like(value, F.lit(r"^[^@]+@[^@]+\z|[\[({](?i:at)[\])}]")))
        .when(kind == "ip", F.regexp_like(value, F.lit(r"^[0-9A-Fa-f]{0,4}+(?:[.:][0-9A-Fa-f]{0,4}+){3,7}+(?:/[0-9]+)?\z")))
        .when(kind == "card", (n >= 12) & (n <= 20) & F.regexp_like(value, F.lit(r"^[0-9][0-9\x20.-]*\z")))
        .otherwise((n >= 7) & (n <= 15) & F.regexp_like(value, F.lit(r"^[+(0-9][\x20()./0-9-]*\z")))
    )


def _occurrences(read: DataFrame) -> DataFrame:
    each = read.select("u1", "u2", F.explode("candidates").alias("c")).select("u1", "u2", "c.*")
    return each.select("u1", "u2", "start", "end", "value", "seed", F.explode("patterns").alias("pattern"))


def induced(edges: DataFrame, belief: DataFrame, support: int, least: float = 0.5) -> DataFrame:
    """(pattern, kind): patterns that at least `support` different strings believed to be of the kind stand in."""
    seeds = belief.filter(F.col("p") >= least)
    return edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("n")).filter(F.col("n") >= support).select("pattern", "kind")


def _background(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, everywhere): how often each of the patterns occurs in the corpus, with a string in it or without."""
    words = F.split(_spaced(ascii_lower(F.coalesce("text", F.lit("")))), " +")
    # a word before or after a string is counted as a word; only pairs of words need their neighbours
    kinds = patterns.select("pattern", F.substring("pattern", 1, 1).alias("k"), F.expr("substring(pattern, 3)").alias("w"))
    ones, twos = kinds.filter("k <> '2'").select("w").distinct(), kinds.filter("k = '2'").select("w").distinct()
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
    counts = _counted(docs.select(F.explode(words).alias("w")), ones)
    if not twos.isEmpty():
        held = F.filter(words, lambda w: w != "")
        counts = counts.unionByName(_counted(docs.select(F.explode(let(held, lambda w: F.when(F.size(w) > 1, pairs(w)))).alias("w")), twos))
    return kinds.join(counts, "w").select("pattern", "everywhere")


def _counted(each: DataFrame, wanted: DataFrame) -> DataFrame:
    side = F.broadcast(wanted) if small(wanted, BROADCAST_PATTERNS) else wanted
    return each.join(side, "w").groupBy("w").agg(F.count("*").alias("everywhere"))


def score_patterns(
    docs: DataFrame, occurrences: DataFrame, rounds: int = 3, support: int = 3, density: float = 0.05, smoothing: float = 1.0
) -> DataFrame:
    """(pattern, kind, sure): how sure each induced pattern is of its kind after `rounds` of mutual scoring."""
    edges = cut(occurrences.groupBy("pattern", F.lower("value").alias("value")).agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    known = edges.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("p")).distinct()
    belief, counted, scored = known, None, None
    for _ in range(rounds):
        chosen = cut(induced(edges, belief, support), "pii-induced")
        if chosen.isEmpty():
            return scored if scored is not None else chosen.withColumn("sure", F.lit(0.0))
        # a label is part of its token, so it has no occurrence without one
        fresh = chosen.filter("not startswith(pattern, '0 ')").select("pattern").distinct()
        fresh = fresh if counted is None else fresh.join(counted, "pattern", "left_anti")
        if counted is None or not fresh.isEmpty():
            new = cut(_background(docs, fresh), "pii-background")
            counted = new if counted is None else counted.unionByName(new)
        own = edges.join(chosen.select("pattern").distinct(), "pattern", "left_semi")
        degree = own.groupBy("pattern").agg(F.count("*").alias("strings"), F.sum("n").alias("filled"))
        sums = own.join(belief, "value").groupBy("pattern", "kind").agg(F.sum("p").alias("p"))
        sure = sums.join(chosen, ["pattern", "kind"]).join(degree, "pattern").join(counted, "pattern", "left")
        sure = sure.filter(F.col("filled") >= density * F.coalesce("everywhere", "filled"))
        scored = cut(sure.select("pattern", "kind", (F.col("p") / (F.col("strings") + smoothing)).alias("sure")), "pii-patterns")
        passed = own.filter("seed is null").join(scored, "pattern").filter(_form(F.col("kind"), F.col("value")))
        passed = passed.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("sure", F.lit(0.999)))))).alias("p"))
        belief = cut(known.unionByName(passed.select("value", "kind", "p")), "pii-beliefs")
    return scored


def find(docs: DataFrame, rounds: int = 3, sure: float = 0.6, support: int = 3, density: float = 0.05) -> DataFrame:
    """Per row of `docs`: doc_id, base (array<struct<rank, start, end, kind>>) and spans, base and discovered."""
    read = _read(docs)
    occurrences = _occurrences(read)
    trusted = score_patterns(docs, occurrences, rounds, support, density).filter(F.col("sure") >= sure)
    trusted = cut(trusted.groupBy("pattern").agg(F.max_by("kind", F.struct("sure", "kind")).alias("kind")), "pii-trusted")
    side = F.broadcast(trusted) if small(trusted, BROADCAST_PATTERNS) else trusted
    marked = occurrences.filter("seed is null").join(side, "pattern").filter(_form(F.col("kind"), F.col("value")))
    marked = marked.groupBy("u1", "u2", "start", "end").agg(F.min("kind").alias("kind"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    found = marked.groupBy("u1", "u2").agg(F.collect_set(F.struct(rank.alias("rank"), "start", "end", "kind")).alias("found"))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    return read.join(found, ["u1", "u2"], "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("found", none))).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(docs).select("doc_id", *[count(k) for k in KINDS], sha256_hex(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
