"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel compares two words by their common subsequences of three letters, gaps allowed and weighted by
DECAY to the power of the span, and is normalised by both words' own values. Letters are what remains of a token
in lower case (other marks and digits inside it are skipped), and runs of single letters are read as one word too, so "i.d.i.o.t", "idxiot" and "i d i o t" all keep most of the subsequences of the plain word.

Fitting takes at most `positives` and `negatives` labelled documents, those with the smallest hash of doc_id.
A toxic document's label says that one of its words is an insult, not which: training alternates between
choosing each toxic document's most telling words (first those that recur in toxic documents and hardly outside) and
fitting the machine on Nystrom features, the kernel against landmark words whitened by the landmarks' own kernel
matrix. Words that tell of three documents or more come with VARIANTS copies that have a letter inserted, and a
VARIED_SHARE of such copies takes part in the calibration. Clean words to learn from
are the COMMON_WORDS commonest, RANDOM_WORDS drawn from all, and each round the HARD_WORDS that the machine so far
takes most for insults, out of all clean words of the sample. Landmarks are chosen among the LANDMARK_WORDS most
frequent words of toxic documents alone, with forms of the FOREMOST of them. A document's score is the calibrated soft maximum of its three highest words.

Kernel, landmarks, whitening and weights are linear in the subsequences, so scoring folds them into one weight
per subsequence; a word's value is exact. Every word of every document is read; a word longer than WIDTH letters
as overlapping pieces.

Defined results: null, empty or wordless text scores as having no telling word. Rows without a label of 0 or 1
aren't learned from; without both labels every score is 0. Repeated rows get equal scores; of rows that share a
labelled doc_id the one with the least text is learned from. Extra columns stay.
"""

import heapq
import itertools
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.llm.common import cut, fold_of

ORDER, DECAY, WIDTH, LANDMARKS, CACHED = 3, 0.5, 20, 256, 400_000
#: Bounds of the fit: labelled documents, words that may be landmarks, those whose forms are landmarks too.
POSITIVES, NEGATIVES, LANDMARK_WORDS, FOREMOST = 1_500, 2_500, 1_200, 40
#: Words a toxic document is learned from, clean words learned from, rounds, copies of an insult with a letter inserted, their share of the rows that calibrate.
WITNESSES, COMMON_WORDS, RANDOM_WORDS, HARD_WORDS, ROUNDS, VARIANTS, VARIED_SHARE = 3, 3_000, 5_000, 1_500, 3, 3, 0.08
#: Fixed value of the contract: the score from which a document is predicted toxic.
THRESHOLD = 0.7
LETTERS = re.compile(r"[\W\d_]+")
#: Codes of letters: a to z, others by their code point, a word's start and end.
OTHERS, START, END, CODES = 36, 62, 63, 64


def read(text: str | None) -> set[str]:
    """The distinct words of a text, in letters only; runs of three single letters or more are words too."""
    if not text:
        return set()
    tokens = text.lower().split()
    words = {LETTERS.sub("", t) for t in set(tokens)}
    if any(len(t) == 1 for t in tokens):
        for single, run in itertools.groupby(tokens, key=lambda t: len(t.strip(".,;:!?*-_")) == 1):
            if single and len(joined := LETTERS.sub("", "".join(run))) >= ORDER:
                words.add(joined)
    return {w for w in words if len(w) >= ORDER}


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= WIDTH else [word[a : a + WIDTH] for a in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers, with their start and end, which count as letters of the subsequences."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), -1)
    out = np.empty((len(words), points.shape[1] + 2), np.int64)
    out[:, 0], out[:, -1] = START, END
    out[:, 1:-1] = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % OTHERS)
    return out


_TRIPLES = {n: np.array(list(itertools.combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER) for n in range(ORDER, WIDTH + 3)}


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: codes of their subsequences (words x triples), equal ones adjacent, and the weights."""
    at = _TRIPLES[len(words[0]) + 2]
    letters = _codes(words)
    codes = (letters[:, at[:, 0]] * CODES + letters[:, at[:, 1]]) * CODES + letters[:, at[:, 2]]
    weights = np.broadcast_to(DECAY ** (at[:, 2] - at[:, 0] + 1).astype(np.float64), codes.shape)
    order = np.argsort(codes, axis=1, kind="stable")
    return np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself: subsequences that recur add up before squaring."""
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    sums = np.add.reduceat(weights.ravel(), np.flatnonzero(first.ravel()))
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])[first.ravel()]
    return np.sqrt(np.bincount(rows, sums**2, len(codes)))


def _by_length(words: list[str]):
    for n, group in itertools.groupby(sorted(range(len(words)), key=lambda i: len(words[i])), key=lambda i: len(words[i])):
        ids = list(group)
        for a in range(0, len(ids), 2048):
            yield ids[a : a + 2048], [words[i] for i in ids[a : a + 2048]]


def linear(words: list[str], table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Normalised subsequence features of `words` times `table`; `rows` says where a code stands in it (default: at its number)."""
    out = np.zeros((len(words), table.shape[1]))
    for ids, group in _by_length(words):
        codes, weights = subsequences(group)
        norm = _norms(codes, weights)
        at = codes if rows is None else rows[codes]
        if table.shape[1] == 1:
            out[ids, 0] = (table[at, 0] * weights).sum(axis=1) / norm
        else:
            for a, i in enumerate(ids):
                out[i] = weights[a] @ table[at[a]] / norm[a]
    return out


def kernel_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table, rows): each word's normalised subsequence vector as a column, and the table's row of every code.

    Only codes that the words have stand in it; the last row, of all other codes, is zero.
    """
    rows, n, parts = np.full(CODES**ORDER, -1, np.int64), 0, []
    for ids, group in _by_length(words):
        codes, weights = subsequences(group)
        fresh = np.unique(codes)
        fresh = fresh[rows[fresh] < 0]
        rows[fresh] = np.arange(n, n + len(fresh))
        n += len(fresh)
        parts.append((ids, codes, weights, _norms(codes, weights)))
    out = np.zeros((n + 1, len(words)), np.float32)
    for ids, codes, weights, norm in parts:
        for a, i in enumerate(ids):
            np.add.at(out[:, i], rows[codes[a]], weights[a] / norm[a])
    rows[rows < 0] = n
    return out, rows


@dataclass
class Model:
    """One weight per subsequence, the machine's bias, and the calibration of a document's value."""

    weights: np.ndarray | None
    bias: float = 0.0
    calibration: tuple[float, float] = (0.0, 0.0)
    landmarks: list[str] = field(default_factory=list)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


#: The value of a text without a word.
NOTHING = -1.5
#: Sharpness of the soft maximum: a second insult counts, one is enough.
SOFT = 3.0


class Scorer:
    """Values of words by the model, made once while they fit."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def values(self, docs: list[set[str]]) -> np.ndarray:
        """Per document: the soft maximum of its three highest word values."""
        if len(self.known) > CACHED:
            self.known.clear()
        new = list(dict.fromkeys(w for d in docs for w in d if w not in self.known))
        parts = [(i, p) for i, w in enumerate(new) for p in pieces(w)]
        if parts:
            value = np.full(len(new), -np.inf)
            np.maximum.at(value, [i for i, _ in parts], linear([p for _, p in parts], self.model.weights[:, None])[:, 0] + self.model.bias)
            self.known.update(zip(new, value.tolist()))
        out = np.full(len(docs), NOTHING)
        for i, d in enumerate(docs):
            if d:
                top = np.array(heapq.nlargest(3, map(self.known.__getitem__, d)))
                out[i] = np.log(np.exp(SOFT * top).sum()) / SOFT
        return np.clip(out, NOTHING, 3.0)

    def scores(self, texts) -> np.ndarray:
        if self.model.weights is None:
            return np.zeros(len(texts))
        a, b = self.model.calibration
        return np.round(1 / (1 + np.exp(-np.clip(a * self.values([read(t) for t in texts]) + b, -30, 30))), 9)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Linear hinge-loss machine by dual coordinate descent; the last column of x is the bias."""
    alpha, w, q = np.zeros(len(y)), np.zeros(x.shape[1]), (x**2).sum(axis=1)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _varied(words: list[str]) -> list[str]:
    """VARIANTS copies of each word with a letter inserted somewhere inside, the same on every run."""
    out = []
    for w in words:
        rng = random.Random(w)
        for _ in range(VARIANTS):
            k = rng.randint(1, len(w) - 1)
            out.append(w[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[k:])
    return out


def train(docs: list[set[str]], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model(None)
    bad, good = [d for d, t in zip(docs, toxic) if t], [d for d, t in zip(docs, toxic) if not t]
    inside, outside = Counter(p for d in bad for w in d for p in pieces(w)), Counter(p for d in good for w in d for p in pieces(w))
    odds = {w: np.log((n + 0.05) / len(bad)) - np.log((outside[w] + 0.5) / len(good)) for w, n in inside.items()}
    telling = sorted((w for w in inside if not outside[w]), key=lambda w: (-inside[w], w))[:LANDMARK_WORDS]
    common = sorted(outside, key=lambda w: (-outside[w], w))
    # landmarks: the words most peculiar to toxic documents, forms of the foremost, and as anchors of the rest some common ones
    chosen = _spread(telling, np.array([inside[w] for w in telling], float), landmarks * 3 // 4) + common[: landmarks // 4]
    foremost = [w for w in telling[:FOREMOST] if inside[w] > 2 and len(w) < WIDTH]
    chosen = list(dict.fromkeys(chosen + _varied(foremost)))
    table, rows = kernel_table(chosen)
    own = (table.T @ table).astype(np.float64)
    values, axes = np.linalg.eigh(own)
    keep = values > 1e-4
    features = table @ (axes[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    rest = sorted(outside)
    drawn = [rest[i] for i in np.random.default_rng(3).permutation(len(rest))[:RANDOM_WORDS]]
    clean = dict.fromkeys(common[:COMMON_WORDS] + drawn)
    negative = linear(list(clean), features, rows)
    flat = [[p for w in sorted(d) for p in pieces(w)] for d in bad]
    witness = [sorted(d, key=lambda w: (-odds[w], w))[:WITNESSES] for d in flat if d]
    for last in (*[False] * (ROUNDS - 1), True):
        often = Counter(w for ws in witness for w in ws)
        pos = sorted(often)
        varied = _varied([w for w in pos if often[w] > 2 and len(w) < WIDTH])
        cost = [0.5 * min(often[w], 20) for w in pos] + [2.0] * len(varied) + [1.0] * len(negative)
        x = np.concatenate([linear(pos + varied, features, rows), negative])
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        w = _svm(x, np.concatenate([np.ones(len(x) - len(negative)), -np.ones(len(negative))]), np.array(cost))
        weights, bias = features @ w[:-1], float(w[-1])
        value = dict(zip(inside, linear(list(inside), weights[:, None], rows)[:, 0] + bias))
        witness = [sorted(d, key=lambda w: (-value[w], w))[:WITNESSES] for d in flat if d]
        if not last:
            # learn next from the clean words most like insults so far, out of all
            hard = np.argsort(-linear(rest, weights[:, None], rows)[:, 0], kind="stable")[:HARD_WORDS]
            fresh = [rest[i] for i in hard if rest[i] not in clean]
            clean |= dict.fromkeys(fresh)
            negative = np.concatenate([negative, linear(fresh, features, rows)]) if fresh else negative
    model = Model(weights.astype(np.float64)[rows], bias, landmarks=chosen)
    scorer = Scorer(model)
    # a share of the rows that calibrate are insults with a letter inserted
    often = Counter(w for ws in witness for w in ws)
    forms = _varied([w for w in sorted(often) if often[w] > 2 and value[w] > 0.8 and len(w) < WIDTH])
    more = np.resize(scorer.values([{w} for w in forms]), int(VARIED_SHARE * len(bad)) + 1) if forms else np.empty(0)
    model.calibration = _calibrate(np.concatenate([scorer.values(docs), more]), np.concatenate([toxic, np.ones(len(more), np.int64)]))
    return model


def _spread(words: list[str], gain: np.ndarray, n: int) -> list[str]:
    """Greedy choice of `n` words of high gain that are unlike those already chosen."""
    kernel, chosen = np.zeros((len(words), len(words)), np.float32), []
    codes, weights, at = [], [], []
    for ids, group in _by_length(words):
        c, w = subsequences(group)
        codes.append(c.ravel())
        weights.append((w / _norms(c, w)[:, None]).ravel())
        at.append(np.repeat(ids, c.shape[1]))
    if words:
        codes, weights, at = np.concatenate(codes), np.concatenate(weights), np.concatenate(at)
        order = np.argsort(codes, kind="stable")
        codes, weights, at = codes[order], weights[order], at[order]
        row = np.cumsum(np.concatenate([[False], codes[1:] != codes[:-1]]))
        # some thousand subsequences at a time
        for a in range(0, row[-1] + 1, 4096):
            own = slice(*np.searchsorted(row, [a, a + 4096]))
            part = np.zeros((4096, len(words)), np.float32)
            np.add.at(part, (row[own] - a, at[own]), weights[own])
            kernel += part.T @ part
    like = np.zeros(len(words))
    for _ in range(min(n, len(words))):
        best = int(np.argmax(np.where(like >= 1, -1, gain * (1 - like))))
        chosen.append(words[best])
        like = np.maximum(like, kernel[best])
        like[best] = 1
    return chosen


def _calibrate(v: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the value, kept from growing steeper than the data can tell."""
    x = np.column_stack([v, np.ones(len(v))])
    w, t = np.zeros(2), toxic.astype(float)
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag([0.05, 1e-6])
        w = w - np.linalg.solve(h, x.T @ (p - t) + np.array([0.05, 0]) * w)
    return tuple(w.tolist())


def _words(frames):
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"], "words": [sorted(read(t)) for t in f["text"]]})


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Learn from bounded numbers of labelled documents outside the held-out fold (crc32 mod 3 = 1)."""
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").cast("int").alias("label"))
    first = lambda label, n: usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = cut(first(1, positives).unionByName(first(0, negatives)), "toxic-chosen")
    # a row per doc_id of the sample, however often it recurs
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = picked.groupBy("doc_id").agg(F.min("text").alias("text")).mapInPandas(_words, "doc_id long, words array<string>").toPandas()
    rows = rows.merge(chosen.toPandas(), on="doc_id").sort_values(["doc_id", "label"])
    return train([set(w) for w in rows["words"]], rows["label"].to_numpy(np.int64))



def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with toxic_score beside its own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer_of(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts))

    return docs.withColumn("toxic_score", scored("text"))


#: The scorer a Python worker has made, for the model it used last.
_HELD: dict[str, Scorer] = {}


def _scorer_of(model: Model) -> Scorer:
    if model.key not in _HELD:
        _HELD.clear()
        _HELD[model.key] = Scorer(model)
    return _HELD[model.key]


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxic_score").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
