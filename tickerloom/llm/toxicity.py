"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each model's input
is how often a text's features recur in it, and the probabilities of all earlier
categories. For training, those probabilities come out of fold: each row's is
predicted by a model that didn't see its fold, so later models learn from
probabilities like those they will get.

Fitting uses a bounded, hash-picked sample of labelled documents (``positives`` and
``negatives`` ids, of which each gives one whole text). Features are a word's first 2 to 8 characters and all
5-grams within words, of whole characters whatever the language, in 2**20 buckets. A
feature's value grows with the logarithm of its frequency per word. The model
keeps the ``width`` buckets that speak most for toxicity by a shrunken deviation between
toxic and other texts; there is no least support, so small tables learn like large ones, and
each feature enters the linear models in proportion to its deviation, which holds chance
features down. Scoring walks all characters of every text.

Categories are label columns, in the order given; the last one decides. The tables have ``toxic`` alone, so
the chain begins with ``kinds`` categories that are found in the training texts: toxic ones are clustered by
the direction of their features (markers of one language or manner go together), and each cluster
is a category. A category with no positive example predicts 0. A document is rejected if the last
category's probability is at least ``threshold``.

Defined results: a null or empty text has probability 0; one without any of the chosen
features has what the models give without them; a text of any length is read whole, in slices;
contradictory labels count as 1, and of an id's different texts the least is learnt from; repeated rows
each get a row and the same probabilities; features that stand equal go by bucket; without labels, or with
labels of one kind, every probability is 0; no rows give no rows; extra columns, whatever their
names, are kept by the filter and ignored by the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import add_sketches, bytes_of, cut_sketch, few_rows, hash_share, written

BITS, GRAM, PREFIX, FOLDS, SLICES = 20, 5, (2, 3, 4, 5, 6, 7, 8), 3, 64
#: Frequencies count in so many words, of which a text has ``LEAST`` more than its own.
PER, LEAST = 100.0, 20
#: A feature's least deviation, in the value's unit, and the linear models' decay.
SHRINK, DECAY = 0.1, 1e-3
#: Characters from here on belong to scripts without spaces: each starts a word.
UNSPACED = 0x2E80
_SPACES = np.array([not chr(c).isalnum() for c in range(UNSPACED)] + [False])
#: Characters that are looked at together.
SLICE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_values(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's features, each once and in order, and their values."""
    low, found, n_words, at = text.decode("utf-8", "replace").lower(), [], 0, 0
    while at < len(low):
        end = at + SLICE
        while end < len(low) and not (ord(low[end]) < UNSPACED and _SPACES[ord(low[end])]):
            end += 1
        buckets, words = _slice_grams(low[at:end])
        found.append(np.unique(buckets, return_counts=True))
        n_words, at = n_words + words, end
    if len(found) == 1:
        bucket, n = found[0]
    else:
        bucket, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(b for b, _ in found)]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([np.zeros(0), *(c for _, c in found)]), minlength=len(bucket))
    return bucket, np.log1p(PER * n / (n_words + LEAST)).astype(np.float32)


def _slice_grams(low: str) -> tuple[np.ndarray, int]:
    """Buckets of all features with repeats, and the number of words."""
    code = np.frombuffer(f" {low} ".encode("utf-32-le", "replace"), np.uint32)
    space = _SPACES[np.minimum(code, UNSPACED)]
    inner = ~space
    start = np.flatnonzero(inner[1:] & (space[:-1] | (code[1:] >= UNSPACED))) + 1
    code, out = code.astype(np.uint64), []
    at, h = start, np.zeros(len(start), np.uint64)
    for k in range(max(PREFIX)):
        stays = inner[at + k]  # the last character is a space, so a word ends before the slice does
        if not stays.all():
            at, h = at[stays], h[stays]
        h = (h ^ code[at + k]) * _MIX
        h ^= h >> np.uint64(29)
        if k + 1 in PREFIX:
            out.append(_buckets(h, k + 1))
    n = len(code) - GRAM + 1
    whole, h = np.ones(max(n, 0), bool), np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        whole &= inner[k : n + k]
        h = (h ^ code[k : n + k]) * _MIX
        h ^= h >> np.uint64(29)
    out.append(_buckets(h[whole], 0))
    return np.concatenate(out), len(start)


def _buckets(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h + np.uint64(kind)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Chain:
    """``place[bucket]`` is the feature's number or -1; a row of ``weights`` for each category and unit of
    value, with the earlier categories' probabilities' weights in ``links``."""

    categories: tuple[str, ...]
    place: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray

    def probabilities(self, text: bytes) -> list[float]:
        if not text:
            return [0.0] * len(self.categories)
        bucket, value = gram_values(text)
        own = self.place[bucket]
        own, value = own[own >= 0], value[own >= 0]
        out: list[float] = []
        for k in range(len(self.categories)):
            g = self.bias[k] + self.weights[k, own] @ value + self.links[k, :k] @ np.array(out, float)
            out.append(float(1 / (1 + np.exp(-np.clip(g, -30, 30)))))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = DECAY) -> np.ndarray:
    """Weights with the bias last; every row weighs the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, first, second = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    weight = np.float32(1 / len(y))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)).astype(np.float32)
        slope[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def fit_chain(chosen: np.ndarray, unit: np.ndarray, x: np.ndarray, y: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """``chosen``: the features' buckets; ``unit``: a deviation of each; ``x``: rows x features, values;
    ``y``: rows x categories of 0 and 1."""
    n_cat, place = len(categories), np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = x / unit.astype(np.float32)
    fold = np.arange(len(y)) % FOLDS
    weights, links, bias, earlier = np.zeros((n_cat, len(chosen))), np.zeros((n_cat, n_cat)), np.full(n_cat, -30.0), np.zeros((len(y), 0), np.float32)
    for k in range(n_cat):
        target, prob = y[:, k].astype(np.float32), np.zeros((len(y), 1), np.float32)
        if target.any() and not target.all():
            full = np.hstack([x, earlier])
            for f in range(FOLDS):
                w = _logistic(full[fold != f], target[fold != f])
                prob[fold == f, 0] = 1 / (1 + np.exp(-np.clip(full[fold == f] @ w[:-1] + w[-1], -30, 30)))
            w = _logistic(full, target)
            weights[k], links[k, :k], bias[k] = w[: len(chosen)], w[len(chosen) : -1], w[-1]
        earlier = np.hstack([earlier, prob])
    return Chain(categories, place, weights / unit, links, bias)


def clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """A cluster number below ``k`` for each row, by direction; the same rows give the same numbers.

    The first centre is the mean; each further one is the row that is least like all centres so far.
    """
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    centres = x.mean(0, keepdims=True)
    while len(centres) < k:
        centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        for c in range(k):
            if (own == c).any():
                mean = x[own == c].mean(0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return (x @ centres.T).argmax(1)


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("toxic",), kinds: int = 3, positives: int = 1500, negatives: int = 4500, width: int = 1024) -> Chain:
    """``docs`` (doc_id, text), ``labels`` (doc_id and ``categories``, 0 or 1, of which the last decides)."""
    last, names = categories[-1], (*(f"kind_{k + 1}" for k in range(kinds)), *categories)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(last).isNotNull())
    n, n_pos = labels.agg(F.count("*"), F.coalesce(F.sum(last), F.lit(0))).first()
    one = labels.where(((F.col(last) == 1) & hash_share(positives / max(1, n_pos), "doc_id")) | ((F.col(last) == 0) & hash_share(negatives / max(1, n - n_pos), "doc_id")))
    marks = F.array(*[F.coalesce(F.max(c), F.lit(0)).cast("int") for c in categories])
    one = one.groupBy("doc_id").agg(marks.alias("marks"))  # about positives + negatives rows
    found = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").groupBy("doc_id", "marks").agg(F.min("text").alias("text"))
    texts = written(found.withColumn("toxic", F.element_at("marks", -1)), "toxicity-labelled")
    n_neg, n_pos = (texts.where(F.col("toxic") == t).count() for t in (0, 1))
    if not n_neg or not n_pos:
        n = len(names)
        return Chain(names, np.full(1 << BITS, -1, np.int32), np.zeros((n, 0)), np.zeros((n, n)), np.full(n, -30.0))
    best = choose(texts, n_pos, n_neg, width).orderBy("bucket").toArrow()
    chosen, unit, stands = (best.column(c).to_numpy() for c in ("bucket", "unit", "stands"))
    unit = unit * (stands.max(initial=0.0) / stands)  # a feature weighs as its deviation, so chance ones weigh little
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            at, of = [], []
            for t in bytes_of(part.column("text")):
                bucket, value = gram_values(t)
                own = sent.value[bucket]
                at.append(own[own >= 0].tobytes())
                of.append(value[own >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("marks"), pa.array(at, pa.binary()), pa.array(of, pa.binary())], names=["doc_id", "marks", "at", "of"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", "marks", "text").mapInArrow(run, f"doc_id {kind}, marks array<int>, at binary, of binary").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in found.column_names)))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (_, _, at, of) in enumerate(rows):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(of, np.float32)
    y = np.array([marks for _, marks, _, _ in rows], float)
    toxic = y[:, -1] == 1
    group = np.full(len(rows), -1)
    if kinds:
        group[toxic] = clusters(x[toxic] / unit.astype(np.float32), kinds)
    return fit_chain(chosen, unit, x, np.hstack([group[:, None] == np.arange(kinds), y]), names)


def choose(texts: DataFrame, n_pos: int, n_neg: int, width: int) -> DataFrame:
    """``texts`` (toxic, text) -> bucket, unit, stands: the ``width`` features that stand furthest above other texts' values.

    A task adds up the values of its texts, and their squares, in vectors of fixed size; these are added up by slice.
    """
    span = (1 << BITS) // SLICES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, 1 << BITS))
        for part in few_rows(parts):
            for t, toxic in zip(bytes_of(part.column("text")), part.column("toxic").to_pylist()):
                bucket, value = gram_values(t)
                sums[2 * (toxic == 1), bucket] += value
                sums[2 * (toxic == 1) + 1, bucket] += value**2
        rows = cut_sketch(sums.reshape(4, SLICES, span).transpose(1, 0, 2).ravel(), SLICES, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(rows["slice"], pa.int32()), pa.array(rows["part"], pa.int32()), pa.array(rows["counts"], pa.binary())], names=["slice", "part", "counts"])

    def stand(k: int, sums: np.ndarray) -> pa.Table:
        neg, neg2, pos, pos2 = sums.reshape(4, span)
        inside = np.maximum((pos2 + neg2 - pos**2 / n_pos - neg**2 / n_neg) / (n_pos + n_neg), 0.0)
        stands = np.round((pos / n_pos - neg / n_neg) / np.sqrt((inside + SHRINK**2) * (1 / n_pos + 1 / n_neg)), 9)
        best = np.argsort(-stands, kind="stable")[:width]
        best = best[stands[best] > 0]
        return pa.table({"bucket": k * span + best, "unit": np.sqrt(inside[best]) + SHRINK, "stands": stands[best]})

    cut = texts.select("toxic", "text").mapInArrow(run, "slice int, part int, counts binary")
    return add_sketches(cut, "float64", finish=stand, schema="bucket long, unit double, stands double").orderBy(F.desc("stands"), "bucket").limit(width)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, a probability for each category, rejected."""
    sent, names = docs.sparkSession.sparkContext.broadcast(chain), [f"{c}_prob" for c in chain.categories]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            probs = np.array([sent.value.probabilities(t) for t in bytes_of(part.column("text"))]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(probs[:, k]) for k in range(len(names))), pa.array(probs[:, -1] >= threshold)], names=["doc_id", *names, "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} double' for n in names)}, rejected boolean")


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    sent, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            good = [sent.value.probabilities(t)[-1] < threshold for t in bytes_of(part.column(at))]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
