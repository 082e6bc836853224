"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature scaling.

A word's index vector is the sum of the sparse ternary vectors of its character trigrams (each derived from a
hash, so any word has one). Its context vector adds the index vectors of its neighbours wherever the fitting
sample uses it (random indexing proper). The model holds the context vectors of the `CONTEXT_WORDS` words that the
sample uses most, of those it uses LEAST_USES times or more; any other word keeps its index vector alone. A document
is pooled over all its words: mean, spread, and how like each word is to the next. A two-layer numpy network
reads the pooled vector, and a temperature fitted on rows set apart from the sample calibrates its output.

Fitting takes at most `sample` labelled rows, those with the smallest hash of doc_id; their words are pooled on
the executors and only pooled vectors and the context vectors reach the driver. Rows are set apart for the
temperature from `APART` labelled rows on; fewer fit it too. Everything else reads every word of every document.

Defined results: null, empty or wordless text pools to zeros and is scored like any other. Rows without a label
of 0 or 1 aren't learned from; without both labels the score is 0.5. Repeated rows get equal scores; of rows that
share a labelled doc_id the one with the least text is learned from; labels for one doc_id that disagree all count.
Extra columns stay.
"""

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.llm.common import cut, fold_of, shield

DIM, NONZERO, HIDDEN = 64, 4, 32
#: Bounds of the fit: labelled rows, words with a context vector, and their least uses in the sample.
SAMPLE, CONTEXT_WORDS, LEAST_USES, APART = 6_000, 20_000, 3, 50
#: Words of one document, or of several short ones, that are worked on at a time; words counted at a time while fitting.
PIECE, FLUSH = 8_192, 50_000
#: Fixed value of the contract: the score from which a document is predicted good.
THRESHOLD = 0.3
TOKEN = re.compile(r"\S+")
POOLED = 2 * DIM + 4


def index_vectors(words: list[str]) -> np.ndarray:
    """Unit index vectors: per word the sum of its trigrams' sparse ternary vectors, ends of the word included."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    gram = (chars[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (chars[2:] * np.uint64(0x165667B19E3779F9))
    # a word of n letters has n trigrams; those across the border of two words go
    starts = np.cumsum(size + 2) - (size + 2)
    own = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    gram = gram[own]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(29)
    word = np.repeat(np.arange(len(words)) * DIM, size)
    out = np.zeros(len(words) * DIM)
    for k in range(NONZERO):
        bits = (gram >> np.uint64(7 * k)).astype(np.int64)
        out += np.bincount(word + (bits & (DIM - 1)), weights=1.0 - 2.0 * ((bits >> 6) & 1), minlength=len(out))
    return _unit(out.reshape(-1, DIM).astype(np.float32))


def _pieces(texts) -> Iterator[tuple[int, list[str]]]:
    """(position, words) of every text, long ones in several pieces; a text's words are never all held at once."""
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= 16 * PIECE:
            words = TOKEN.findall(text)
            for a in range(0, len(words), PIECE):
                yield i, words[a : a + PIECE]
        else:
            found = (m[0] for m in TOKEN.finditer(text))
            while words := list(islice(found, PIECE)):
                yield i, words


def _gathered(pieces, size: int = PIECE) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(positions, words, starts): pieces put together to some thousand words."""
    at, words, starts = [], [], []
    for i, piece in pieces:
        if words and len(words) + len(piece) > size:
            yield np.array(at), words, np.array(starts)
            at, words, starts = [], [], []
        at.append(i)
        starts.append(len(words))
        words.extend(piece)
    if words:
        yield np.array(at), words, np.array(starts)


class Vectors:
    """Vectors of words: index vectors, and context vectors where the model has them."""

    def __init__(self, context: dict[str, int] | None = None, near: np.ndarray | None = None):
        self.context, self.near = context or {}, near

    def of(self, words: list[str]) -> np.ndarray:
        number = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        own = index_vectors(list(number))
        if self.context:
            row = np.fromiter((self.context.get(w, -1) for w in number), np.int64, len(number))
            known = row >= 0
            own[known] = _unit(own[known] + self.near[row[known]])
        return own[ids]

    def pooled(self, texts) -> np.ndarray:
        """One row per text: mean and spread of its words' vectors, likeness of neighbours, length."""
        m = len(texts)
        n, total, squares, alike = np.zeros(m), np.zeros((m, DIM)), np.zeros((m, DIM)), np.zeros(m)
        # a long text's piece is compared with the last word of the piece before it
        last_at, last = -1, None
        for at, words, starts in _gathered(_pieces(texts)):
            own = self.of(words)
            near = np.zeros(len(own), np.float32)
            near[1:] = np.einsum("ij,ij->i", own[1:], own[:-1])
            near[starts] = 0
            if at[0] == last_at:
                near[0] = own[0] @ last
            last_at, last = at[-1], own[-1].copy()
            # a text has one piece here: pieces of one text fill a gathering each
            total[at] += np.add.reduceat(own, starts, axis=0)
            squares[at] += np.add.reduceat(own * own, starts, axis=0)
            alike[at] += np.add.reduceat(near, starts)
            n[at] += np.diff([*starts, len(own)])
        count = np.maximum(n, 1)
        mean = total / count[:, None]
        chars = np.fromiter((len(t) if t else 0 for t in texts), np.float64, m)
        tail = (alike / np.maximum(n - 1, 1), np.sqrt((mean**2).sum(axis=1)), np.log1p(n) / 10, np.minimum(chars / count / 20, 10) * (n > 0))
        return np.column_stack([mean, np.sqrt(np.maximum(squares / count[:, None] - mean**2, 0)), *tail]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-6)[:, None]


@dataclass
class Model:
    """The network with its input scaling and temperature, and the context vectors of the sample's words."""

    context: dict[str, int]
    near: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple | None
    temperature: float = 1.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), 0.5)
        # rounded, so that batches of another size give the same score
        return np.round(1 / (1 + np.exp(-np.clip(self.logit(pooled) / self.temperature, -30, 30))), 9)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = np.clip((pooled - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ w1 + b1) @ w2 + b2


def train(pooled: np.ndarray, label: np.ndarray, context: dict[str, int], near: np.ndarray, epochs: int = 60) -> Model:
    """Fit the network on four fifths of the rows by Adam, the temperature on the rest."""
    pooled = pooled.astype(np.float64)
    if len(label) == 0 or label.min() == label.max():
        return Model(context, near, np.zeros(POOLED), np.ones(POOLED), None)
    model = Model(context, near, pooled.mean(axis=0), pooled.std(axis=0) + 1e-3, None)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(label))
    apart = np.zeros(len(label), bool)
    apart[order[: len(label) // 5]] = True
    if len(label) < APART or label[apart].min(initial=1) == label[apart].max(initial=0):
        apart[:] = False
    x, y = np.clip((pooled[~apart] - model.mean) / model.scale, -8, 8), label[~apart].astype(np.float64)
    w = [rng.normal(0, POOLED**-0.5, (POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            xb, yb = x[order[a : a + 64]], y[order[a : a + 64]]
            h = np.tanh(xb @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - yb) / len(yb)
            dh = np.outer(d, w[2]) * (1 - h**2)
            grads = [xb.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(w)
    held = apart if apart.any() else ~apart
    z, t = model.logit(pooled[held]), label[held]
    grid = np.geomspace(0.5, 8, 60)
    loss = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _counts(frames):
    """Uses of the sample's words, some thousand words at a time."""
    count = Counter()
    for f in frames:
        for _, words in _pieces(f["text"]):
            count.update(words)
            if len(count) > FLUSH:
                yield pd.DataFrame({"word": list(count), "n": list(count.values())})
                count.clear()
    if count:
        yield pd.DataFrame({"word": list(count), "n": list(count.values())})


def _contexts(chosen: dict[str, int]):
    """Summed neighbour vectors of the chosen words in a part of the sample: (word, near)."""

    def run(frames):
        vectors, sums = Vectors(), np.zeros((len(chosen) + 1, DIM), np.float32)
        met = np.zeros(len(chosen) + 1, bool)
        for f in frames:
            last_at, last = -1, None
            for at, words, starts in _gathered(_pieces(f["text"])):
                own = vectors.of(words)
                near = np.zeros_like(own)
                near[1:] += own[:-1]
                near[:-1] += own[1:]
                # neighbours are of one text; a piece goes on where the text's last one ended
                for a in starts[1:]:
                    near[a] -= own[a - 1]
                    near[a - 1] -= own[a]
                row = np.fromiter((chosen.get(w, len(chosen)) for w in words), np.int64, len(words))
                if at[0] == last_at:
                    near[0] += last[1]
                    sums[last[0]] += own[0]
                last_at, last = at[-1], (row[-1], own[-1].copy())
                np.add.at(sums, row, near)
                met[row] = True
        found = [(w, sums[i]) for w, i in chosen.items() if met[i]]
        if found:
            yield pd.DataFrame(found, columns=["word", "near"])

    return run


def _pool(shared):
    def run(frames):
        vectors = Vectors(*shared.value)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "pooled": list(vectors.pooled(f["text"]))})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, context_words: int = CONTEXT_WORDS) -> Model:
    """Learn from at most `sample` labelled documents outside the held-out fold (crc32 mod 5 = 0)."""
    spark = docs.sparkSession
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(fold_of(F.col("doc_id"), 5) != 0)
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # a row per doc_id of the sample, however often it recurs
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = cut(picked.groupBy("doc_id").agg(F.min("text").alias("text")), "quality-sample").repartition(8, "doc_id").sortWithinPartitions("doc_id")
    # the words first, then the sums of their neighbours alone
    uses = texts.mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_USES)
    chosen_words = [r.word for r in uses.orderBy(F.desc("n"), "word").limit(context_words).select("word").collect()]
    number = {w: i for i, w in enumerate(chosen_words)}
    parts = texts.mapInPandas(_contexts(number), "word string, near array<float>")
    near = parts.groupBy("word").agg(*[F.sum(F.col("near")[i]).alias(f"v{i}") for i in range(DIM)]).orderBy("word")
    top = near.select("word", F.array(*[F.round(f"v{i}", 4).cast("float") for i in range(DIM)]).alias("near")).toPandas()
    context = {w: i for i, w in enumerate(top["word"])}
    values = _unit(np.stack(top["near"].to_numpy()).astype(np.float32)) if len(top) else np.zeros((0, DIM), np.float32)
    shared = spark.sparkContext.broadcast((context, values))
    rows = texts.mapInPandas(_pool(shared), "doc_id long, pooled array<float>").toPandas().merge(chosen.toPandas(), on="doc_id")
    rows = rows.sort_values(["doc_id", "label"])
    pooled = np.stack(rows["pooled"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, POOLED))
    return train(pooled, rows["label"].to_numpy(np.int64), context, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with quality_score beside its own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = _vectors_of(shared.value)
        for texts in batches:
            yield pd.Series(shared.value.score(vectors.pooled(texts)) if len(texts) else np.zeros(0))

    return docs.withColumn("quality_score", scored("text"))


#: The word vectors a Python worker has made, for the model it used last.
_HELD: dict[str, Vectors] = {}


def _vectors_of(model: Model) -> Vectors:
    if model.key not in _HELD:
        _HELD.clear()
        _HELD[model.key] = Vectors(model.context, model.near)
    return _HELD[model.key]


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows scored under `threshold`."""
    safe, own = shield(docs, "doc_id", "text")
    return score(safe, fit(safe, labels)).filter(F.col("quality_score") >= threshold).select(*own)
