"""Secret scan by fixed patterns and sliding-window entropy per character class, in DataFrame functions only.

Candidate strings are runs of token characters apart from the base spans. A window of WINDOW characters slides over
each. Characters belong to four classes (lower case, upper case, digits, marks); per class the window's number of
characters n and the sum of c * log2(c) over its characters' counts c are kept by adding the character that enters
and taking out the one that leaves, so that the class's Shannon entropy, log2(n) - sum / n, costs no recount.
A class but the marks is random in a window if it has at least CLASS_CHARS characters and its entropy comes to EVEN of
what so many characters of it can have at most. A string is a secret if in some window at least two random classes cover
COVER of the characters. Strings on the allow list (identifiers, paths, host names, placeholders) are suppressed.

The counts are five bits each, twelve to a long, in eight longs: a step takes the same time whatever the length.

Defined results: null text is empty text. Repeated rows get equal results, a null doc_id is a document like any
other; extra columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantscope.llm.common import sha256_hex
from grantscope.llm.spans import apart, as_spans, joined, let, matched

KINDS = ("assign", "access", "hex", "entropy")
#: The contract's patterns; those with a least length hold it here, which finds the same matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}+"
WINDOW, CLASS_CHARS, EVEN, COVER = 16, 4, 0.7, 0.75
#: Characters a class has: lower case, upper case, digits; marks only part words and make no class random.
CLASS_SIZES = (26, 26, 10)
#: What looks random and isn't a secret: any of these (a host or file name takes both of its patterns).
ALLOWED = (
    (r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z",),  # UUIDs
    (r"^[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z", r"\.(?:com|org|net|io|dev|edu|gov|html?|json|ya?ml|md|txt|py|js|png|jpe?g|css)\z"),
    (r"^(?:[./_-]*+[A-Za-z]++[0-9]{0,3}+[./_=-]++){2,}+[0-9.]*+[A-Za-z0-9]*+\z",),  # paths, compounds of words, versions
    (r"^[a-z]*+(?:[A-Z]{1,5}+[a-z]{2,}+[0-9]{0,3}+)++\z",),  # CamelCase
    (r"(?i)example|placeholder|changeme|your[_-]|dummy|sample|redacted|xxxx|0123456789|abcdefgh",),
    (r"^(.{1,4}?)\1++\z",),  # repeats
)


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def random_window(value: Column, window: int = WINDOW, even: float = EVEN, cover: float = COVER) -> Column:
    """Whether two random classes cover enough of any `window` characters of `value` (false for a shorter one)."""
    if window > 31:
        raise ValueError("counts have five bits: a window has 31 characters at most")
    weight = _doubles(0 if c < 2 else c * math.log2(c) for c in range(window + 1))
    needed = [_doubles(even * math.log2(max(1, min(n, size))) for n in range(window + 1)) for size in CLASS_SIZES]
    needed = F.array(*needed, _doubles([math.inf] * (window + 1)))
    bits = _doubles(math.log2(max(n, 1)) for n in range(window + 1))
    code = lambda c: F.greatest(F.lit(0), F.least(F.lit(95), F.ascii(c) - 32))
    kind = lambda c: F.when(c.between(65, 90), 0).when(c.between(33, 58), 1).when(c.between(16, 25), 2).otherwise(3)
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), code)
    event = lambda c, by, full: F.struct(
        F.floor(c / 12).cast("int").alias("word"), (c % 12 * 5).alias("shift"), kind(c).alias("kind"), F.lit(by).alias("by"), full.alias("full")
    )

    def moves(cs: Column) -> Column:
        # at each position the character that leaves, then the one that enters
        enters = lambda c, i: event(c, 1, i >= window - 1)
        leaves = lambda i: event(F.get(cs, i - window), -1, F.lit(False))
        return F.flatten(F.transform(cs, lambda c, i: F.when(i >= window, F.array(leaves(i), enters(c, i))).otherwise(F.array(enters(c, i)))))

    def random(n: Column, sums: Column, tables: Column) -> Column:
        def held(x: Column, k: Column) -> Column:
            evenly = F.get(tables["bits"], x) - F.get(sums, k) / x >= F.get(F.get(tables["needed"], k), x)
            return F.when((x >= CLASS_CHARS) & evenly, x).otherwise(0)

        total = F.aggregate(F.transform(n, held), F.struct(F.lit(0).alias("chars"), F.lit(0).alias("classes")), lambda a, x: F.struct((a["chars"] + x).alias("chars"), (a["classes"] + F.when(x > 0, 1).otherwise(0)).alias("classes")))
        return let(total, lambda t: (t["classes"] >= 2) & (t["chars"] >= math.ceil(cover * window)))

    def step(tables: Column):
        def move(s: Column, e: Column) -> Column:
            had = F.call_function("shiftright", F.get(s["counts"], e["word"]), e["shift"]).bitwiseAND(31).cast("int")
            gain = let(had, lambda h: F.get(tables["weight"], h + e["by"]) - F.get(tables["weight"], h))
            counts = F.transform(s["counts"], lambda v, k: F.when(k == e["word"], v + F.call_function("shiftleft", F.lit(1).cast("long"), e["shift"]) * e["by"]).otherwise(v))
            n = F.transform(s["n"], lambda v, k: F.when(k == e["kind"], v + e["by"]).otherwise(v))
            sums = F.transform(s["sums"], lambda v, k: F.when(k == e["kind"], v + gain).otherwise(v))
            moved = F.struct(counts.alias("counts"), n.alias("n"), sums.alias("sums"), s["hit"].alias("hit"))
            judged = lambda m: F.struct(m["counts"].alias("counts"), m["n"].alias("n"), m["sums"].alias("sums"), random(m["n"], m["sums"], tables).alias("hit"))
            return F.when(s["hit"], s).otherwise(let(moved, lambda m: F.when(e["full"], judged(m)).otherwise(m)))

        return move

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), 8).alias("counts"), F.array_repeat(F.lit(0), 4).alias("n"),
        F.array_repeat(F.lit(0.0), 4).alias("sums"), F.lit(False).alias("hit"),
    )
    tables = F.struct(weight.alias("weight"), needed.alias("needed"), bits.alias("bits"))
    return let(tables, lambda t: F.aggregate(let(codes, moves), start, step(t), lambda s: s["hit"]))


def looks_secret(value: Column, allowed: tuple[tuple[str, ...], ...] = ALLOWED) -> Column:
    known = F.lit(False)
    for patterns in allowed:
        every = F.lit(True)
        for pattern in patterns:
            every = every & F.regexp_like(value, F.lit(pattern))
        known = known | every
    # two classes with CLASS_CHARS characters each are needed in any case
    several = lambda cls: F.char_length(F.regexp_replace(value, f"[^{cls}]", "")) >= CLASS_CHARS
    mixed = sum((several(cls).cast("int") for cls in ("a-z", "A-Z", "0-9")), F.lit(0)) >= 2
    return F.when(~mixed | known, False).otherwise(random_window(value))


def find(docs: DataFrame, allowed: tuple[tuple[str, ...], ...] = ALLOWED) -> DataFrame:
    """Per row of `docs`: doc_id, base and spans (arrays of struct<start, rank, end, kind>, in order)."""
    text = F.coalesce("text", F.lit(""))
    by_start = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    assigned = F.filter(matched(text, ASSIGN, F.regexp_like(text, F.lit("[:=]"))), lambda m: F.char_length(F.regexp_replace(m["text"], ASSIGNED, "")) >= 8)
    access = matched(text, ACCESS, F.contains(text, F.lit("AKIA")))
    base = F.concat(as_spans(assigned, 0, "assign"), as_spans(access, 1, "access"), as_spans(matched(text, HEX), 2, "hex"))
    ordered = F.array_sort(by_start(base))

    def more(spans: Column) -> Column:
        free = apart(matched(text, CANDIDATE), spans)
        some = F.filter(free, lambda m: let(F.rtrim(m["text"], F.lit(".=-")), lambda v: looks_secret(v, allowed)))
        return F.struct(spans.alias("base"), F.array_sort(F.concat(spans, by_start(as_spans(some, 3, "entropy")))).alias("spans"))

    return docs.select("doc_id", let(ordered, more).alias("found")).select("doc_id", "found.base", "found.spans")


def query(docs: DataFrame) -> DataFrame:
    rows = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS[:3]], sha256_hex(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
