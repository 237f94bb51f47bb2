"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; everything else the model sees is
unlabelled web text, so labels of 0 teach it nothing but the class prior, which is
estimated as the share of 1 among labelled training rows. A linear model over
binned shape statistics minimises the non-negative unbiased risk
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with the logistic
loss; where the second part falls below zero, the step goes the other way, as
published. The logistic loss makes sigmoid(g) an estimate of the probability of
label 1.

Fitting uses bounded samples, picked by hashes: ``positives`` labelled ids, of which each gives
one text (the least, if its rows differ), and ``unlabelled`` different texts, all of them
whole; scoring covers every row.

Defined results: a null text is empty, and an empty text is scored like any other, as is one of
any length; ids with contradictory labels are no trusted positives; with no positives or no
unlabelled rows the score is the prior (0.5 if there are no labels); a null id is
not held out; repeated rows each get a row and the same score; a score equal to ``threshold``
predicts 1; no rows give no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import bytes_of, few_rows, hash_share

STATS = 14
BINS = 12
_KIND = np.zeros(256, np.int64)
for _i, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"#*$%&|<>{}[]=/_\\^~@+`", bytes(range(128, 256)))):
    _KIND[list(_members)] = _i + 1


def stats_of(text: bytes) -> list[float]:
    """Shape statistics of a whole text; all are shares or logarithms."""
    words, size = text.split(), max(len(text), 1)
    by_kind = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=10)
    n = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same_next = sum(map(bytes.__eq__, words, words[1:]))
    upper = sum(map(bytes.isupper, counts))
    return [
        np.log1p(len(words)),
        size / n,
        by_kind[2] / size,
        by_kind[3] / size,
        by_kind[5] / size,
        by_kind[6] / n,
        by_kind[7] / n,
        by_kind[8] / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        same_next / n,
        1 - len(set(lines)) / max(len(lines), 1),
        upper / max(len(counts), 1),
        len(set(zip(words, words[1:]))) / n,
    ]


@dataclass
class PuModel:
    edges: np.ndarray  # STATS x (BINS - 1)
    weights: np.ndarray
    bias: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        """One-hot bins of every statistic."""
        out = np.zeros((len(stats), STATS * BINS))
        for j in range(STATS):
            out[np.arange(len(stats)), j * BINS + np.searchsorted(self.edges[j], stats[:, j], "right")] = 1
        return out

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(stats) @ self.weights + self.bias, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> PuModel:
    """Non-negative risk minimisation with Adam steps over the samples' statistics."""
    start = float(np.log(prior / (1 - prior)))
    edges = np.quantile(unlabelled, np.concatenate([[0.01, 0.03], np.linspace(0.08, 0.92, BINS - 5), [0.97, 0.99]]), axis=0).T if len(unlabelled) else np.zeros((STATS, BINS - 1))
    model = PuModel(edges, np.zeros(STATS * BINS), start)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.features(positive), model.features(unlabelled)
    w = np.zeros(STATS * BINS + 1)
    w[-1] = start
    p, u = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        loss = lambda x: np.logaddexp(0, -x).mean()
        negative = loss(-gu) - prior * loss(-gp)
        slope_n = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        if negative >= 0:
            slope = -prior * (p.T @ sigmoid(-gp)) / len(p) + slope_n
        else:
            slope = -slope_n
        slope[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return PuModel(edges, w[:-1], float(w[-1]))


def _sample_stats(rows: DataFrame) -> np.ndarray:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            yield pa.RecordBatch.from_pydict({"s": pa.array([stats_of(t) for t in bytes_of(part.column("text"))], pa.list_(pa.float64()))})

    got = rows.select("text").mapInArrow(run, "s array<double>").toArrow().column("s").to_pylist()
    return np.array(got, float).reshape(-1, STATS)


def _one_text(docs: DataFrame) -> DataFrame:
    """One text for each id, so a frequent id is no large part of a sample."""
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000) -> PuModel:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, label), training rows of both."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    n, mean = labels.agg(F.count("*"), F.avg("label")).first()
    prior = min(max(mean, 0.01), 0.99) if n else 0.5
    trusted = labels.where(hash_share(positives / max(1.0, n * prior), "doc_id")).groupBy("doc_id").agg(F.min("label").alias("least")).where("least = 1")  # about ``positives`` ids
    p = _sample_stats(_one_text(docs.join(F.broadcast(trusted), "doc_id", "left_semi")))
    total = docs.select("doc_id").count()
    u = _sample_stats(docs.where(hash_share(unlabelled / max(1, total), "doc_id", "text")).select("text").distinct())
    return fit_pu(p, u, prior)


def score(docs: DataFrame, model: PuModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            stats = np.array([stats_of(t) for t in bytes_of(part.column("text"))], float).reshape(-1, STATS)
            s = sent.value.score(stats)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
